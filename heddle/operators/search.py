"""Ranked full-text search and nearest vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import vectors
from heddle.functions.text import tokens
from heddle.session import remove


def clamp_k(k: int) -> int:
    return min(100, max(1, k))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf), the term counted within each document by a partial aggregate."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def text_search(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text", digits: int = 5) -> DataFrame:
    """Documents by the sum, over the query's tokens (repeats count again), of ln(1 + N / (df + 0.5)) * tf / (tf + 1.2).

    The query's terms are few and known, so each document's counts are taken in the scan, row by
    row, with no explosion of postings; one narrow aggregate gives N and df, and top-k never sorts the corpus.
    """
    spark = docs.sparkSession
    words = [r.t for r in spark.range(1).select(F.explode(tokens(F.lit(query))).alias("t")).collect()]
    terms = sorted(set(words))
    if not terms:
        return spark.createDataFrame([], "id string, score double")
    tf = F.array(*[F.size("__tokens") - F.size(F.array_remove("__tokens", w)) for w in terms])
    hits = docs.select(F.col(id_col).cast("string").alias("id"), tokens(F.col(text_col)).alias("__tokens")).select("id", tf.alias("tf"))
    df = hits.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        f = F.col("tf")[i].cast("double")
        score = score + F.lit(float(words.count(w))) * F.log(1 + F.col("n") / (F.col(f"df{i}") + 0.5)) * f / (f + 1.2)
    found = hits.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(df), how="inner", on=F.lit(True))  # one row
    return found.select("id", F.round(score, digits).alias("score")).orderBy(F.desc("score"), "id").limit(clamp_k(k))


#: Words that are counted and ordered at once; a text with more is by itself.
RUN_WORDS = 2_000_000


def _run(ids: list, words: list):
    """Postings (term, id, tf) of some texts, in order of term and then text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words, ids = pa.chunked_array(words).combine_chunks(), pa.chunked_array(ids).combine_chunks()
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    text = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    keys, tf = np.unique(rank[coded.indices.to_numpy()] * len(words) + text, return_counts=True)
    terms = coded.dictionary.take(pa.array(order[keys // len(words)]))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(keys % len(words))), terms, pa.array(tf, pa.int64())], names=["id", "term", "tf"])


def _runs(batches):
    ids, words, n = [], [], 0
    for b in batches:
        lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
        start = 0
        for i, more in enumerate(lengths.tolist()):
            if n and n + more > RUN_WORDS:
                yield from _parts(_run([*ids, b.column(0).slice(start, i - start)], [*words, b.column(1).slice(start, i - start)]))
                ids, words, n, start = [], [], 0, i
            n += more
        ids.append(b.column(0).slice(start))
        words.append(b.column(1).slice(start))
    if n:
        yield from _parts(_run(ids, words))


def _parts(run, rows: int = 65_536):
    return (run.slice(i, rows) for i in range(0, run.num_rows, rows))


def write_text_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> str:
    """An inverted index below `path`: postings (id, term, tf), stats (n).

    Each task counts the words of its own texts and writes them in runs of RUN_WORDS words, ordered by
    term: nothing is shuffled, spilled or sorted as a whole, and a query reads the pages of each run that
    hold its terms. Rows that share an id are added up by the query. `buckets` has no effect any more.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), tokens(F.col(text_col)).alias("words"))
    rows.mapInArrow(_runs, _POSTINGS).write.parquet(f"{path}/postings")
    docs.agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/stats")
    return path


_POSTINGS = "id string, term string, tf long"


def index_search(spark: SparkSession, path: str, query: str, k: int, digits: int = 5) -> DataFrame:
    """text_search by an index: what is read grows with the postings of the query's terms, not with the corpus."""
    asked = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    words = {r.term: r.times for r in asked.collect()}  # the query's own words
    if not words:
        return spark.createDataFrame([], "id string, score double")
    n = spark.read.schema("n long").parquet(f"{path}/stats").first().n
    hits = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("term").isin(*words))
    hits = hits.repartition("id").groupBy("id", "term").agg(F.sum("tf").alias("tf"))  # both groupings keep this dealing
    found = {r.term: r.df for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a word
    if not found:
        return spark.createDataFrame([], "id string, score double")
    weight = F.lit(0.0)
    for w, df in found.items():
        weight = F.when(F.col("term") == w, F.lit(words[w] * math.log(1 + n / (df + 0.5)))).otherwise(weight)
    scored = hits.groupBy("id").agg(F.sum(weight * F.col("tf") / (F.col("tf") + 1.2)).alias("score"))
    return scored.select("id", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "id").limit(clamp_k(k))


def exact_search(space: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 5) -> DataFrame:
    """The k vectors of largest cosine; ids break ties as text. Vectors that aren't valid in the space are left out."""
    if not any(query):
        raise ValueError("the query is zero")
    v = F.col(vector_col)
    rows = space.where(vectors.valid(v, len(query))).select(F.col(id_col).cast("string").alias("id"), vectors.normalised(v).alias("unit"))
    score = F.round(vectors.cosine_constant(F.col("unit"), query), digits)
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(clamp_k(k))


#: Queries and vectors, at most, that are compared at once, and pairs whose exact scores are taken at once.
BLOCK_QUERIES, BLOCK_VECTORS, BLOCK_PAIRS = 1024, 8192, 1 << 16


class _Best:
    """The k best (score, id) of each query among the vectors offered so far.

    Blocks are compared in single precision; pairs that could be among the best by it, within its error,
    get their exact scores, so that the result is that of double precision throughout.
    """

    def __init__(self, queries: np.ndarray, k: int, digits: int):
        self.queries, self.single, self.k, self.digits = queries, queries.astype(np.float32), k, digits
        self.score, self.ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), "", object)
        self.error = 2e-7 * max(1, queries.shape[1])

    def offer(self, rows: np.ndarray, vectors: np.ndarray, names: np.ndarray) -> None:
        """Vectors in single precision, with their ids, to the queries at `rows`."""
        for v in range(0, len(vectors), BLOCK_VECTORS):
            for q in range(0, len(rows), BLOCK_QUERIES):
                self._block(rows[q : q + BLOCK_QUERIES], vectors[v : v + BLOCK_VECTORS], names[v : v + BLOCK_VECTORS])

    def _block(self, rows: np.ndarray, vectors: np.ndarray, names: np.ndarray) -> None:
        near, low = self.single[rows] @ vectors.T, self.score[rows, -1]
        new = np.isneginf(low)
        if new.any() and len(vectors) > self.k:
            low[new] = np.partition(near[new], len(vectors) - self.k, axis=1)[:, -self.k] - self.error
        r, c = np.nonzero(near >= (low - self.error - 10.0**-self.digits)[:, None])
        if not len(r):
            return
        score = np.concatenate([np.einsum("ij,ij->i", self.queries[rows[r[i : i + BLOCK_PAIRS]]], vectors[c[i : i + BLOCK_PAIRS]].astype(float)) for i in range(0, len(r), BLOCK_PAIRS)])
        score = np.round(score, self.digits)
        kept = score >= np.round(low - self.error, self.digits)[r]
        r, c, score = r[kept], c[kept], score[kept]
        met = np.unique(r)
        held = np.repeat(met, self.k)
        r, score, ids = np.concatenate([r, held]), np.concatenate([score, self.score[rows[met]].ravel()]), np.concatenate([names[c], self.ids[rows[met]].ravel()])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, r))
        first = np.searchsorted(r[order], met)
        best = order[first[:, None] + np.arange(self.k)]  # each query holds k entries already
        self.score[rows[met]], self.ids[rows[met]] = score[best], ids[best]

    def found(self, asked: list):
        import pyarrow as pa

        for i in range(0, len(asked), BLOCK_QUERIES):
            r, c = np.nonzero(~np.isneginf(self.score[i : i + BLOCK_QUERIES]))
            columns = [pa.array([asked[i + x] for x in r], pa.int64()), pa.array(self.ids[i + r, c].tolist(), pa.string()), pa.array(self.score[i + r, c])]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])


def _live(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of an Arrow column's vectors are valid in the space, and those at unit length in single precision, as vectors.valid and vectors.normalised."""
    import pyarrow.compute as pc

    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    v = column.filter(right).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)  # a null part is NaN here
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    rows, v = np.nonzero(right.to_numpy(zero_copy_only=False))[0][good], v[good]
    return rows, (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _spread(space: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) over many tasks, before anything is computed of them."""
    return space.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("vector")).repartition(_tasks(space.sparkSession))


_FOUND = "query long, id string, score double"


def _tasks(spark: SparkSession) -> int:
    """Over how many tasks the comparison of vectors is spread, however few files they come in."""
    return max(12, 2 * spark.sparkContext.defaultParallelism)


def _k_best(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("r", best).where(F.col("r") <= k).drop("r")


def exact_search_all(space: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 5, dim: int = 64) -> DataFrame:
    """exact_search for a set of queries (query, vector), some ten thousand at most: (query, id, score).

    The queries go to all tasks as one matrix; blocks of them are compared with blocks of vectors, and only
    a task's own best k of each query leave it. The work is that of all pairs, dealt over the tasks; memory
    is that of the queries, their best and one block.
    """
    spark, k = queries.sparkSession, clamp_k(k)
    asked = queries.where(vectors.valid(F.col("vector"), dim)).select("query", vectors.normalised(F.col("vector")).alias("v")).toArrow()
    ids, matrix = asked["query"].to_pylist(), np.array(asked["v"].to_pylist(), float).reshape(-1, dim)
    told = spark.sparkContext.broadcast((ids, matrix))

    def run(batches):
        ids, matrix = told.value
        best = _Best(matrix, k, digits)
        for b in batches:
            rows, unit = _live(b.column(1), dim)
            if len(rows) and len(ids):
                best.offer(np.arange(len(ids)), unit, np.array(b.column(0).to_pylist(), object)[rows])
        yield from best.found(ids)

    return _k_best(_spread(space, id_col, vector_col).mapInArrow(run, _FOUND), k)


#: Below so many live vectors a partition an index would compare them all anyway.
EXACT_BELOW = 2048
#: Vectors, at most, on which the lists' centres are fitted and the probes chosen; every vector is in a list.
CENTRE_SAMPLE, PROBE_SAMPLE, PROBE_QUERIES = 50_000, 20_000, 200
#: The recall of the ten nearest that an index is built for.
RECALL = 0.97


def _units(points: np.ndarray) -> np.ndarray:
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)


def _centres(points: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit vectors from seeded points of theirs, in blocks; a centre that draws nothing stays."""
    centres = points[np.random.default_rng(seed).permutation(len(points))[:lists]].astype(float)
    for _ in range(rounds):
        single = _units(centres).astype(np.float32)
        at = np.concatenate([(points[i : i + BLOCK_VECTORS] @ single.T).argmax(1) for i in range(0, len(points), BLOCK_VECTORS)])
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(centres) + 1))
        for c in np.nonzero(first[1:] > first[:-1])[0]:
            centres[c] = points[order[first[c] : first[c + 1]]].mean(0, dtype=float)
    return _units(centres)


def _share_to_probe(points: np.ndarray, centres: np.ndarray) -> float:
    """The least share of the lists, in sixteenths, in which PROBE_QUERIES of the points find RECALL of their ten nearest."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    at = (unit @ centres.T).argmax(1)
    asked = unit[np.random.default_rng(7).permutation(len(unit))[:PROBE_QUERIES]]
    near = np.argsort(-(asked @ unit.T), axis=1)[:, :10]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each list in a query's order
    needed = np.take_along_axis(place, at[near], 1)
    for sixteenths in range(1, 16):
        if (needed < math.ceil(sixteenths * len(centres) / 16)).mean() >= RECALL:
            return sixteenths / 16
    return 1.0


def write_vector_index(space: DataFrame, path: str, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> str:
    """An index that outlives its queries, below `path`: centres (list, centre), vectors (list, id, unit) in order of list, stats (n, dim, share).

    There are about as many lists as vectors in a list. Centres are fitted on at most CENTRE_SAMPLE
    vectors, and the share of the lists that a query reads on at most PROBE_SAMPLE; all vectors are
    normalised once and go to the list of their nearest centre. Where directions are spread evenly that
    share is large, and with it the cost; where they lie in groups it is small.
    """
    spark = space.sparkSession

    def normalise(batches):
        import pyarrow as pa

        for b in batches:
            rows, unit = _live(b.column(1), dim)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dim), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), parts], names=["id", "unit"])

    _spread(space, id_col, vector_col).mapInArrow(normalise, "id string, unit array<float>").write.parquet(f"{path}/units")
    live = spark.read.schema("id string, unit array<float>").parquet(f"{path}/units")
    n = live.count()
    sampled = live if n <= CENTRE_SAMPLE else live.sample(CENTRE_SAMPLE / n, seed=seed)
    points = sampled.select("unit").limit(2 * CENTRE_SAMPLE).toArrow()["unit"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    fitted = _centres(points, max(2, round(n**0.5)), seed) if n else np.zeros((0, dim))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(fitted)]
    spark.createDataFrame(centres, "list int, centre array<double>").write.parquet(f"{path}/centres")
    share = _share_to_probe(points[np.random.default_rng(seed).permutation(len(points))[:PROBE_SAMPLE]].astype(float), fitted) if n else 1.0
    spark.createDataFrame([(n, dim, share)], "n long, dim int, share double").write.parquet(f"{path}/stats")
    told = spark.sparkContext.broadcast(_units(fitted))

    def place(batches):
        import pyarrow as pa

        for b in batches:
            unit = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim).astype(float)
            near = [(unit[i : i + BLOCK_QUERIES] @ told.value.T).argmax(1) for i in range(0, b.num_rows, BLOCK_QUERIES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, int), *near]), pa.int32()), *b.columns], names=["list", "id", "unit"])

    placed = live.repartition(_tasks(spark)).mapInArrow(place, "list int, id string, unit array<float>")
    placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(f"{path}/vectors")
    remove(spark, f"{path}/units")
    return path


def index_nearest(spark: SparkSession, path: str, query: list[float], k: int, ef: int = 64, partitions: int = 1, digits: int = 5, whole: bool = False) -> DataFrame:
    """Approximate nearest neighbours by an index: the lists whose centres are nearest are read and ranked exactly.

    They are the share of the lists that the index was built to need, and at least as many as hold about
    max(k, ef) vectors. A space of at most min(ef * M * 2, EXACT_BELOW) vectors a partition (M is 32 from 64
    dimensions on, else 16) is searched whole, and with `whole` one of any size, so that the result is exact.
    """
    stats = spark.read.schema("n long, dim int, share double").parquet(f"{path}/stats").first()
    if len(query) != stats.dim or not any(query):
        raise ValueError("the query isn't a vector of the space")
    k, ef = clamp_k(k), min(256, max(clamp_k(k), ef))
    rows = spark.read.schema("list int, id string, unit array<float>").parquet(f"{path}/vectors")
    if not whole and stats.n > min(ef * (32 if stats.dim >= 64 else 16) * 2, EXACT_BELOW) * partitions:
        centres = spark.read.schema("list int, centre array<double>").parquet(f"{path}/centres")
        score = vectors.cosine_constant(F.col("centre"), query) / vectors.norm(F.col("centre"))
        chosen = centres.select("list", score.alias("s")).orderBy(F.desc("s"), "list").limit(_probes(stats, ef)).collect()  # at most the square root of the vectors
        rows = rows.where(F.col("list").isin(*[r.list for r in chosen]))
    score = F.round(vectors.cosine_constant(F.col("unit"), query), digits)
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _probes(stats, ef: int) -> int:
    lists = max(2, round(stats.n**0.5))
    return min(lists, max(math.ceil(stats.share * lists), math.ceil(ef * lists / max(1, stats.n))))


def index_nearest_all(queries: DataFrame, path: str, k: int, ef: int = 64, digits: int = 5) -> DataFrame:
    """The same for a set of queries (query, vector), as many as exact_search_all takes: (query, id, score), always by lists.

    Queries are given their lists in tasks, and go to all tasks as a matrix with a bit for each list; each
    list's vectors are compared with the queries that have it.
    """
    spark, k = queries.sparkSession, clamp_k(k)
    stats = spark.read.schema("n long, dim int, share double").parquet(f"{path}/stats").first()
    dim, probes = stats.dim, _probes(stats, ef)
    stored = spark.read.schema("list int, centre array<double>").parquet(f"{path}/centres").orderBy("list").toArrow()  # the square root of the vectors
    lists, centres = np.array(stored["list"].to_pylist(), np.int64), _units(np.array(stored["centre"].to_pylist(), float).reshape(-1, dim))
    told_centres = spark.sparkContext.broadcast(centres)

    def choose(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, BLOCK_QUERIES):
                part = b.slice(i, BLOCK_QUERIES)
                unit = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim).astype(float)
                near, has = np.argsort(-(unit @ told_centres.value.T), axis=1, kind="stable")[:, :probes], np.zeros((part.num_rows, len(told_centres.value)), bool)
                np.put_along_axis(has, near, True, 1)
                bits = pa.array([x.tobytes() for x in np.packbits(has, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bits], names=["query", "v", "lists"])

    asked = queries.where(vectors.valid(F.col("vector"), dim)).select(F.col("query").cast("long").alias("query"), vectors.normalised(F.col("vector")).alias("v"))
    asked = asked.mapInArrow(choose, "query long, v array<float>, lists binary").toArrow()
    bits = np.frombuffer(b"".join(asked["lists"].to_pylist()), np.uint8).reshape(asked.num_rows, -1) if asked.num_rows else np.zeros((0, 1), np.uint8)
    told = spark.sparkContext.broadcast((asked["query"].to_pylist(), np.array(asked["v"].to_pylist(), float).reshape(-1, dim), bits, lists))

    def run(batches):
        ids, matrix, bits, lists = told.value
        best = _Best(matrix, k, digits)
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            at = b.column(0).to_numpy()
            unit, names = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim), np.array(b.column(1).to_pylist(), object)
            for x in np.unique(at):
                here, i = at == x, int(np.searchsorted(lists, x))
                best.offer(np.nonzero(bits[:, i >> 3] >> (7 - (i & 7)) & 1)[0], unit[here], names[here])
        yield from best.found(ids)

    rows = spark.read.schema("list int, id string, unit array<float>").parquet(f"{path}/vectors")
    return _k_best(rows.repartitionByRange(_tasks(spark), "list", "id").sortWithinPartitions("list").mapInArrow(run, _FOUND), k)


def latest_vectors(writes: DataFrame, id_col: str, seq_col: str, vector_col: str) -> DataFrame:
    """Upserts and removals (null vector) in order: the last write of each id that isn't a removal."""
    last = writes.groupBy(id_col).agg(F.max_by(F.struct(vector_col), seq_col).alias("__v"))
    return last.select(id_col, F.col(f"__v.{vector_col}").alias(vector_col)).where(F.col(vector_col).isNotNull())


def index_stats(space: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """Vectors and their bytes in single precision, by group."""
    return space.groupBy(by).agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.size(vector_col) * 4).alias("bytes"))
