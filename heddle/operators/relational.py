"""Lookups, scans, pages, set operations, lenient aggregates and joins over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import glob_to_regex
from heddle.session import scratch


def point_lookup(df: DataFrame, key_col: str, key) -> DataFrame:
    """The row of one key; none if it is missing."""
    return df.where(F.col(key_col) == F.lit(key))


def multi_get(df: DataFrame, key_col: str, keys: list) -> DataFrame:
    """A row for each of `keys`, in order and with repeats; nulls where a key is missing.

    The keys come from the caller's statement: they filter the scan as literals, and the few rows found
    are then joined back to the keys.
    """
    spark, kind = df.sparkSession, df.schema[key_col].dataType.simpleString()
    wanted = spark.createDataFrame(list(enumerate(keys)), f"ordinal int, `{key_col}` {kind}")
    found = df.where(F.col(key_col).isin(*dict.fromkeys(keys)))
    return wanted.join(found, key_col, "left").orderBy("ordinal")


def ordered_scan(df: DataFrame, key_col: str, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(key_col).asc_nulls_last())
    return out if limit is None else out.limit(limit)


def scan_after(df: DataFrame, key_col: str, cursor, limit: int) -> DataFrame:
    """The page of rows with keys strictly above the cursor."""
    return df.where(F.col(key_col) > F.lit(cursor)).orderBy(key_col).limit(limit)


def key_range(df: DataFrame, key_col: str, start, end) -> DataFrame:
    """Keys from `start`, inclusive, to `end`, exclusive; none if the range is empty or reversed."""
    return df.where((F.col(key_col) >= F.lit(start)) & (F.col(key_col) < F.lit(end)))


def match_keys(df: DataFrame, key_col: str, pattern: str, after: str | None = None, count: int | None = None) -> DataFrame:
    """Keys that match a glob, in order; with a cursor and a count, one page of an iteration."""
    out = df.where(F.col(key_col).rlike(glob_to_regex(pattern)))
    if after is not None:
        out = out.where(F.col(key_col) > after)
    return out if count is None else out.orderBy(key_col).limit(count)


def table_bytes(df: DataFrame, value_col: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(value_col).cast("string"))), F.lit(0)).alias("bytes"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY, OFFSET, LIMIT: the whole set is ordered, never a part of it."""
    return df.orderBy(*order).offset(offset).limit(limit)


def chunks(df: DataFrame, order_col: str, size: int) -> DataFrame:
    """`df` with `chunk`, numbered batches of 1 to 500 rows in order.

    Rows are numbered by range partition: each partition numbers its own rows, and the partitions'
    sizes, one row each, give the offsets; no single task sees the table. The ranged rows are stored,
    so that both sides of the join see the same partitions.
    """
    size = min(500, max(1, size))
    spark, path = df.sparkSession, scratch(df.sparkSession)
    ranged = df.repartitionByRange(order_col).sortWithinPartitions(order_col).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return ranged.join(F.broadcast(before), "__p").withColumn("chunk", F.floor((F.col("__b") + F.col("__i")) / size)).drop("__p", "__i", "__b", "__n")


def lenient_sum(c: Column) -> Column:
    """The sum of what parses as a number; null if nothing does."""
    return F.sum(c.try_cast("double"))


def lenient_avg(c: Column) -> Column:
    return F.avg(c.try_cast("double"))


def lenient_extreme(c: Column, largest: bool = True) -> Column:
    """Largest or least: as numbers if every value is one, else as text."""
    f = F.max if largest else F.min
    by = F.max_by if largest else F.min_by
    number = c.try_cast("double")
    return F.when(F.count(c) == F.count(number), by(c, number)).otherwise(f(c))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose foreign key, if they have one, has no parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys of a unique constraint that occur more than once; keys with a null are never equal."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_violations(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that a CHECK rejects; unknown passes."""
    return df.where(~F.coalesce(predicate, F.lit(True)))


def overlay(base: DataFrame, newer: DataFrame, key: str, deleted: str = "deleted") -> DataFrame:
    """`base` under `newer` rows of the same columns and a flag: the newer row wins, a deleted one hides the key."""
    columns = base.columns
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    n = newer.select(*[F.col(c).alias(f"n_{c}") for c in columns], F.col(deleted).alias("n_deleted"))
    both = b.join(n, F.col(f"b_{key}") == F.col(f"n_{key}"), "full").where(~F.coalesce("n_deleted", F.lit(False)))
    new = F.col(f"n_{key}").isNotNull()
    return both.select(*[F.when(new, F.col(f"n_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in columns])


def range_lookup(df: DataFrame, key_col: str, ranges: DataFrame, width: int) -> DataFrame:
    """`df` with the `range_id` of the range (start, end or null) that holds its whole-number key.

    Ranges don't overlap. Keys and ranges meet in buckets of `width` keys, so that this is an equi-join
    that Spark can shuffle; an open range ends at the largest key.
    """
    top = df.agg(F.max(key_col).alias("__top"))
    r = ranges.join(F.broadcast(top), how="inner", on=F.lit(True))  # one row
    last = F.floor(F.coalesce(F.col("end") - 1, F.greatest("__top", "start")) / width)
    r = r.where(F.col("end").isNull() | (F.col("end") > F.col("start"))).select("range_id", F.col("start").alias("__a"), F.col("end").alias("__b"), F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("__bucket"))
    hit = (F.col("__at") == F.col("__bucket")) & (F.col(key_col) >= F.col("__a")) & (F.col("__b").isNull() | (F.col(key_col) < F.col("__b")))
    return df.withColumn("__at", F.floor(F.col(key_col) / width)).join(r, hit, "left").drop("__a", "__b", "__at", "__bucket")
