"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots, random directions), in order. It is posted to the
inverted lists of its first few pivots; vectors of one list that share enough of their whole
descriptions are candidates, and each candidate is verified by its cosine in double precision.
Equal vectors are one entry with a count. Long lists are parted into tiles, so that no task holds
more than two parts of a list, and a tile returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from heddle.llm.common import bounded_batches, components, looked_up, materialise

#: Pivots of a description, lists that a vector is posted to, shared pivots that make a candidate.
DESCRIBED, POSTED, SHARED = 12, 6, 4
#: Pivots grow with the square root of the vectors, within these bounds, as long as the recall at the least cosine is REACH.
PIVOTS, REACH = (64, 4096), 0.99
#: The least cosine of a link.
LEAST = 0.93
#: Vectors of a list's part.
TILE = 2_000


def make_pivots(dim: int, n: int) -> np.ndarray:
    """`n` seeded random directions. They know nothing of the data, so a group of near copies draws no pivots to itself,
    and how far two descriptions agree depends on the two vectors' angle, not on what else the table holds."""
    p = np.random.default_rng(dim).standard_normal((n, dim))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def describe(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each unit row, nearest first."""
    return np.argsort(-np.round(x @ pivots.T, 9), axis=1, kind="stable")[:, :DESCRIBED]


def are_candidates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows' descriptions share a posted pivot and SHARED described ones."""
    same = a[:, :, None] == b[:, None, :]
    return same[:, :POSTED, :POSTED].any((1, 2)) & (same.sum((1, 2)) >= SHARED)


def pivot_count(dim: int, most: int) -> int:
    """How many pivots, `most` or a half, a fourth and so on, find seeded pairs of the least cosine with a recall of REACH.

    In few dimensions many pivots lie within a link's angle. With POSTED of them every pair is a candidate.
    """
    if dim == 1:  # vectors of one sign have one description
        return most
    x, u = np.random.default_rng([dim, 1]).standard_normal((2, 2_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(1, keepdims=True) * x
    y = LEAST * x + math.sqrt(1 - LEAST**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    while most > POSTED and are_candidates(describe(x, p := make_pivots(dim, most)), describe(y, p)).mean() < REACH:
        most = max(POSTED, most // 2)
    return most


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, fp, vec): the vector at a common scale and its fingerprint, null for vectors that link with nothing."""
    for b in batches:
        arr = b.column(1)
        values = arr.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 counts as 0.0
        offsets, there = arr.offsets.to_numpy(), (pc.and_(arr.is_valid(), b.column(2).is_valid())).to_numpy(zero_copy_only=False)
        vecs = []
        for i in range(b.num_rows):
            v = values[offsets[i] : offsets[i + 1]]
            ok = there[i] and len(v) and np.isfinite(v).all() and v.any()
            if ok:  # so that no square over- or underflows
                v = v / math.ldexp(1.0, int(np.frexp(np.abs(v).max())[1]))
                short = v.astype(np.float32)  # half the bytes, where nothing is lost
                v = short if (short == v).all() else v
            vecs.append((b"f" if v.dtype == np.float32 else b"d") + v.tobytes() if ok else None)
        fps = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "label", "fp", "vec"])


def _numbers(vec: bytes) -> np.ndarray:
    """A stored vector in double precision."""
    return np.frombuffer(vec, np.float32 if vec[:1] == b"f" else np.float64, offset=1).astype(np.float64)


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one tile: for each entry that has some, the vectors linked here and the least number of its component here."""
    none = pd.DataFrame({"node": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64"), "root": pd.Series([], dtype="int64")})
    pdf = pdf.sort_values("node", kind="stable")
    same, pivot = bool(pdf.ti.iloc[0] == pdf.tj.iloc[0]), int(pdf["pivot"].iloc[0])
    x = np.stack([_numbers(v) for v in pdf.vec])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    desc = np.stack([np.frombuffer(d, np.int16) for d in pdf.desc])
    first, weight, nodes = pdf.part.to_numpy() == pdf.ti.iloc[0], pdf.m.to_numpy(), pdf.node.to_numpy()
    numbers = np.unique(desc)
    member = np.zeros((len(x), len(numbers)), np.float32)
    np.put_along_axis(member, np.searchsorted(numbers, desc), 1, axis=1)
    posted = np.zeros_like(member)
    np.put_along_axis(posted, np.searchsorted(numbers, desc[:, :POSTED]), 1, axis=1)
    earlier = posted[:, : np.searchsorted(numbers, pivot)]  # a pair counts in the first list that both are in
    rows, cols = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
    links, left, right = np.zeros(len(x), np.int64), [], []
    for at in range(0, len(rows), 256):
        r = rows[at : at + 256]
        candidates = (member[r] @ member[cols].T >= SHARED) & (earlier[r] @ earlier[cols].T == 0)
        if same:
            candidates &= r[:, None] < cols[None, :]
        i, j = np.nonzero(candidates)
        for k in range(0, len(i), 1 << 17):
            a, b = r[i[k : k + (1 << 17)]], cols[j[k : k + (1 << 17)]]
            hit = np.einsum("ij,ij->i", x[a], x[b]) >= LEAST
            left.append(a[hit])
            right.append(b[hit])
    a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
    if not len(a):
        return none
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    root = np.arange(len(x))  # rows are in the entries' order
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    has = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[has], "links": links[has], "root": nodes[root[has]]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept; linked are vectors of equal label and length with cosine >= LEAST.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a
    label, link with nothing and are their own component. Vectors of unlike lengths don't link.
    Labels may be of any type that groups. Repeated rows, and rows that share an id, are vectors of their
    own. A null id can't name a component. An empty table gives an empty result; other columns are ignored. The index finds a link if the two share a posted pivot
    and SHARED described ones; the number of pivots is held to where that finds REACH of the pairs of
    the least cosine, whatever groups the table has, and tests measure the recall. Pairs of one dense
    group are all compared, so the work grows with the square of its unlike vectors.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    label = rows.schema["label"]
    all_ = materialise(rows.mapInArrow(_valid, StructType([StructField("vec_id", LongType()), label, StructField("fp", BinaryType()), StructField("vec", BinaryType())])), "vectors")
    entries = all_.where("fp is not null").groupBy("label", "fp").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"))
    entries = materialise(entries.withColumn("node", F.monotonically_increasing_id()), "vector-entries")
    n = entries.count()
    n_pivots = int(min(PIVOTS[1], max(PIVOTS[0], 2 ** math.ceil(math.log2(max(1, n)) / 2))))
    length = F.floor((F.octet_length("vec") - 1) / F.when(F.substring("vec", 1, 1) == F.lit(b"f"), 4).otherwise(8)).cast("int")
    counts = {r.dim: pivot_count(r.dim, n_pivots) for r in entries.select(length.alias("dim")).distinct().collect()}

    def described_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            vecs = [_numbers(v) for v in b.column(0).to_pylist()]
            out: list = [None] * len(vecs)
            for dim in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                if dim not in made:
                    made[dim] = make_pivots(dim, counts[dim])
                x = np.stack([vecs[i] for i in at])
                for i, d in zip(at, describe(x / np.linalg.norm(x, axis=1, keepdims=True), made[dim]), strict=True):
                    out[i] = d.astype(np.int16)
            lists = pa.array([d[:POSTED].tolist() for d in out], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(v) for v in vecs], pa.int32()), pa.array([d.tobytes() for d in out], pa.binary()), lists], names=["vec", "node", "m", "label", "dim", "desc", "pivots"])

    fields = [StructField("vec", BinaryType()), StructField("node", LongType()), StructField("m", LongType()), label, StructField("dim", IntegerType()), StructField("desc", BinaryType()), StructField("pivots", ArrayType(IntegerType()))]
    described = materialise(entries.select("vec", "node", "m", "label").mapInArrow(described_by, StructType(fields)), "vector-described")
    # lists of one vector end here, before any vector moves
    lists = described.select("label", "dim", F.explode("pivots").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = materialise(lists.select(F.col("label").alias("__l"), F.col("dim").alias("__d"), F.col("pivot").alias("__p"), F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "vector-lists")
    posts = looked_up(described.withColumn("pivot", F.explode("pivots")), lists, {"label": "__l", "dim": "__d", "pivot": "__p"}, "inner")
    posts = posts.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("label", "dim", "pivot", F.least("part", "other").alias("ti"), F.greatest("part", "other").alias("tj"), "part", "node", "m", "vec", "desc")
    found = materialise(tiles.groupBy("label", "dim", "pivot", "ti", "tj").applyInPandas(_tile, "node long, links long, root long"), "vector-links")
    links = found.groupBy(F.col("node").alias("__n")).agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector").withColumnsRenamed({"node": "__c", "component": "klass"})
    told = entries.drop("vec").join(links, F.col("node") == F.col("__n"), "left").join(member, F.col("node") == F.col("__c"), "left")
    told = materialise(told.select("label", "fp", "rep", F.coalesce("klass", "node").alias("klass"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n")), "vector-told")
    least = told.groupBy(F.col("klass").alias("__k")).agg(F.min("rep").alias("c"))
    told = told.join(least, F.col("klass") == F.col("__k")).select(F.col("label").alias("__l"), F.col("fp").alias("__f"), "n", "c")
    out = all_.drop("vec").join(told, (F.col("label") == F.col("__l")) & (F.col("fp") == F.col("__f")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_ids AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN least_ids ON least_ids.a = vec_id
"""


def op5_vector_near_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
