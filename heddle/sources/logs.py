"""Version logs, write-ahead logs, segments and archives as Parquet below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import remove

LOG = "pk string, commit_ts long, value string, expires_at long"


def export_history(log: DataFrame, path: str, start: str | None = None, end: str | None = None) -> None:
    """All versions, or those of a routing range of keys (start inclusive, end exclusive), clustered by key so that footers prune."""
    if start is not None:
        log = log.where(F.col("pk") >= start)
    if end is not None:
        log = log.where(F.col("pk") < end)
    log.repartitionByRange("pk").sortWithinPartitions("pk", "commit_ts").write.parquet(path)


def import_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


#: Rows, about, that a task orders at once.
TASK_ROWS = 500_000


def parts(rows: DataFrame) -> int:
    """Into how many partitions rows are dealt, so that each holds about TASK_ROWS: adaptive execution doesn't join them again."""
    return -(-rows.count() // TASK_ROWS) or 1


def write_segment(rows: DataFrame, store: str, segment_id: int, kind: str, bloom_rows: int = 1_000_000) -> None:
    """An immutable sorted segment, kind snapshot, delta or compacted, with a Bloom filter on the key; a segment that is there is an error."""
    if kind not in ("snapshot", "delta", "compacted"):
        raise ValueError(kind)
    out = rows.repartitionByRange(parts(rows), "pk").sortWithinPartitions("pk", "commit_ts").write.mode("error")
    out.option("parquet.bloom.filter.enabled#pk", "true").option("parquet.bloom.filter.expected.ndv#pk", str(bloom_rows)).parquet(f"{store}/segment_id={segment_id}/kind={kind}")


def read_segments(spark: SparkSession, store: str) -> DataFrame:
    """All segments' rows with segment_id and kind, which prune by folder."""
    return spark.read.schema(f"{LOG}, segment_id long, kind string").option("basePath", store).parquet(store)


def live_segments(segments: DataFrame, keep_snapshots: int = 1) -> DataFrame:
    """Segments (segment_id, kind) that the newest kept snapshots don't supersede: those from the oldest kept snapshot on."""
    kept = segments.where("kind in ('snapshot', 'compacted')").orderBy(F.desc("segment_id")).limit(keep_snapshots)
    floor = kept.agg(F.coalesce(F.min("segment_id"), F.lit(0)).alias("floor"))
    return segments.join(F.broadcast(floor), F.col("segment_id") >= F.col("floor")).drop("floor")  # one row


def append_wal(rows: DataFrame, path: str) -> None:
    """Append (lsn, commit_ts, payload)."""
    rows.select("lsn", "commit_ts", "payload").write.mode("append").parquet(path)


def read_wal(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """Entries after a position, in order."""
    return spark.read.schema("lsn long, commit_ts long, payload string").parquet(path).where(F.col("lsn") > after).orderBy("lsn")


def truncate_wal(spark: SparkSession, path: str, target: str, through: int) -> None:
    """Entries after `through` to a new log; the old one stays until the caller drops it."""
    spark.read.schema("lsn long, commit_ts long, payload string").parquet(path).where(F.col("lsn") > through).write.parquet(target)


def prune(spark: SparkSession, store: str, keep_snapshots: int = 1) -> int:
    """Remove the segments that the newest kept snapshots supersede; how many. Readers that hold an older listing should be done."""
    all_ = read_segments(spark, store).select("segment_id", "kind").distinct()
    gone = all_.join(live_segments(all_, keep_snapshots).select("segment_id"), "segment_id", "left_anti").collect()  # a row a segment
    for r in gone:
        remove(spark, f"{store}/segment_id={r.segment_id}")
    return len(gone)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A whole state: every table in a folder of its own, and last a table of their names, so that a snapshot without one isn't whole."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/tables/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n,) for n in sorted(tables)], "name string").coalesce(1).write.parquet(f"{path}/names")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {r.name: spark.read.parquet(f"{path}/tables/{r.name}") for r in spark.read.parquet(f"{path}/names").collect()}


def archive(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Rows to an object store, with a manifest (file, rows, checksum) to tell later if an object has changed."""
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(max(int(before), 64)))  # a writer a value, up to so many, instead of a task's rows in order of `by`
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(f"{path}/objects")
    finally:
        conf.set(key, before)
    manifest(df.sparkSession, f"{path}/objects").write.parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy(F.regexp_extract(F.input_file_name(), "/objects/(.*)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("checksum"))


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of the manifest's objects whose rows don't match it now."""
    now = manifest(spark, f"{path}/objects").withColumnsRenamed({"rows": "rows_now", "checksum": "checksum_now"})
    then = spark.read.parquet(f"{path}/manifest")
    return then.join(now, "file", "left").where(~(F.col("rows").eqNullSafe(F.col("rows_now")) & F.col("checksum").eqNullSafe(F.col("checksum_now")))).select("file", "rows")
