"""What the operators share: working tables in the shared folder, Python columns by Arrow batch, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Spaces that part words: \x20 and \x09-\x0D, the same that bytes.split() knows.
SPACES = " \t\n\x0b\x0c\r"

#: Rows and bytes of an Arrow batch, where the session sets none: a task holds a few batches at once, in the JVM and in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Bytes of a Parquet row group, where the session sets none: the unit in which texts are buffered and dealt to tasks again.
ROW_GROUP = str(16 << 20)
#: A lookup table of at most so many rows is broadcast; beyond it the join is a salted shuffle.
MOST_BROADCAST, SALTS = 200_000, 32

#: Spark's switch that deletes a query's shuffle files as soon as it ends; else they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_DIRS: dict[str, str] = {}

#: Bytes of a word that are hashed by table, and words and bytes of texts that are hashed at once.
TABLE_BYTES, HASHED_WORDS, HASHED_BYTES = 32, 1 << 13, 1 << 16

#: Odd factors by which the places of an n-gram differ; no sum of some of them less others is divisible by 2^6.
ODD = [np.uint64(x) for x in (0x5692161D100B05E5, 0xDBD238973A2B148B, 0x1E535EEDE31428F1, 0xB7A4712C74562915, 0xB6BF613DBEBB45DD)]


def mix_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers to others, one to one, each bit of which depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte at each of a word's first places (place * 256 + byte), and the same with A-Z read as a-z.
EXACT = mix_bits(np.arange(1, TABLE_BYTES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FOLDED = EXACT.reshape(TABLE_BYTES, 256).copy()
FOLDED[:, 65:91] = FOLDED[:, 97:123]
FOLDED = FOLDED.ravel()
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


def word_hashes(data: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts in a row, and where in them each text's begin, with their number last.

    `data`: the texts' bytes, `ends`: where the first begins, then where each ends. A word is the sum
    of its bytes' numbers, mixed; one of over TABLE_BYTES bytes is hashed by xxh3.
    """
    from xxhash import xxh3_64_intdigest

    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    borders = ends[(ends > 0) & (ends < len(data))]
    first[borders] = word[borders]
    last[borders - 1] = word[borders - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), HASHED_WORDS):
        size = np.minimum(sizes[lo : lo + HASHED_WORDS], TABLE_BYTES)
        at = np.cumsum(size) - size
        step = np.ones(int(at[-1] + size[-1]), np.uint8)  # a byte's place in its word, by adding up modulo 256
        step[at[1:]] = (1 - size[:-1]) & 255
        step[0] = 0
        place = np.cumsum(step, dtype=np.uint8).astype(np.int64)
        chars = data[place + np.repeat(starts[lo : lo + len(size)], size)]
        place <<= 8
        place |= chars
        out[lo : lo + len(size)] = np.add.reduceat(table[place], at)
    out = mix_bits(out)
    for i in np.flatnonzero(sizes > TABLE_BYTES):
        long = data[starts[i] : starts[i] + sizes[i]].tobytes()
        out[i] = xxh3_64_intdigest(long.lower() if table is FOLDED else long)
    return out, np.searchsorted(starts, ends)


def bounded_bytes(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about HASHED_BYTES together, one at least; `ends` as for word_hashes."""
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + HASHED_BYTES, "right")) - 1)
        yield lo, hi
        lo = hi


def bounded_batches(spark: SparkSession) -> None:
    """BATCH for the session's Python stages, unless the session has limits of its own."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def bounded_row_groups(spark: SparkSession) -> None:
    """ROW_GROUP for what the session writes, unless it has a size of its own."""
    if spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", ROW_GROUP)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where `df` has columns so named."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder; a cluster gets an error, since a
    folder of one machine would lose the rows that other machines wrote.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL_DIRS.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="heddle-")
        _LOCAL_DIRS[sc.applicationId] = base
    return f"{base.rstrip('/')}/heddle-{sc.applicationId}"


def working_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage ends there and is safe from lost executors.

    The write's shuffle files are deleted with it, as nothing reads them again.
    """
    spark, path = df.sparkSession, working_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", spark.conf.get("parquet.block.size", ROW_GROUP)).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a stored working table that everything made of it has been stored since."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete this application's working tables; frames that read them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(rows: DataFrame, table: DataFrame, keys: dict[str, str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """`rows` joined with `table` (both stored, `table` with one row a key) on `keys`, column of rows -> column of table; all names must differ.

    The table is broadcast if it has at most MOST_BROADCAST rows. Beyond that it is shuffled, and each
    key's rows are dealt to `salts` tasks and the table's row to all of them, so that a hot key isn't
    one task's; give 1 where keys of `rows` can't be hot.
    """
    if table.count() <= MOST_BROADCAST:
        on = [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()]
        return rows.join(F.broadcast(table), on, how)
    (salt,) = fresh(rows, "__salt")
    if salts > 1:
        rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        table = table.withColumn(f"{salt}_t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = keys | {salt: f"{salt}_t"}
    return rows.join(table, [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()], how).drop(salt, f"{salt}_t")


def append_columns(df: DataFrame, inputs: list[str], fields: list[StructField], make: Callable[[], Callable[..., Iterable[Iterable]]]) -> DataFrame:
    """`df` with `fields` appended, computed from the columns `inputs` one Arrow batch at a time.

    `make()` runs once in each task and returns a function from the lists of a batch's inputs to one
    list or Arrow array for each field. Columns of `df` pass through as they are; a field whose name `df` has takes its place.
    """
    bounded_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    places = [df.schema.names.index(c) for c in inputs]
    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in new]
    schema = StructType(kept + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            out = f(*[b.column(i).to_pylist() for i in places])
            made = [v if isinstance(v, pa.Array) else pa.array(list(v), t.type) for v, t in zip(out, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + made, names=[x.name for x in kept] + arrow.names)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph `edges` (a, b: long), component the smallest node reachable.

    Alternating large and small stars: every round links each node's larger neighbours to its smallest
    one, then its smaller neighbours likewise. Rounds work on narrow rows and end in a written table;
    minima are pre-aggregated before the shuffle, and the joins with them are ones that adaptive
    execution can split on hot nodes. It ends when a round changes nothing.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-links")
    seen = None
    for _ in range(rounds):
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, links = links, materialise(small.where("u <> v").distinct(), f"{name}-stars")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.groupBy("u").agg(F.min("v").alias("c")).select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("c").alias("component")), F.struct(F.col("c").alias("node"), F.col("c").alias("component")))).alias("x")).select("x.node", "x.component").distinct()
