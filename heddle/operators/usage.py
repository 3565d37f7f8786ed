"""Metering, bills, latency quantiles, statement rollups and write loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import fingerprint

# fixed values: metrics and their unit prices in millionths
PRICES = {"read_unit": 1, "write_unit": 5, "stored_byte": 0, "egress_byte": 1, "realtime_message": 1, "connection_minute": 10}


def metered(events: DataFrame) -> DataFrame:
    """(tenant, database, metric, quantity, events): a repeated idempotency key counts once, in any tenant; empty ones always count.

    Which of a key's events counts follows from its sequence `seq`: the first.
    """
    keyed = events.where("idempotency_key <> ''").groupBy("idempotency_key").agg(F.min_by(F.struct("tenant", "database", "metric", "quantity"), "seq").alias("e")).select("e.*")
    free = events.where("coalesce(idempotency_key, '') = ''").select("tenant", "database", "metric", "quantity")
    return keyed.unionByName(free).groupBy("tenant", "database", "metric").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("events"))


def bills(totals: DataFrame) -> DataFrame:
    """A row for each tenant with all metrics, 0 where there is none."""
    wide = totals.groupBy("tenant").pivot("metric", list(PRICES)).agg(F.sum("quantity"))
    return wide.select("tenant", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in PRICES]).orderBy("tenant")


def invoice(totals: DataFrame, tenant: str, prices: dict[str, int] = PRICES) -> DataFrame:
    """Lines (metric, quantity, unit_micros, amount_micros, total_micros) of one tenant, without zero quantities."""
    price = totals.sparkSession.createDataFrame(sorted(prices.items()), "metric string, unit_micros long")
    lines = totals.where(F.col("tenant") == tenant).groupBy("metric").agg(F.sum("quantity").cast("long").alias("quantity")).where("quantity <> 0").join(F.broadcast(price), "metric")
    lines = lines.withColumn("amount_micros", F.col("quantity") * F.col("unit_micros"))
    return lines.withColumn("total_micros", F.sum("amount_micros").over(Window.partitionBy())).orderBy("metric")


def latency(samples: DataFrame, by: str, value: str, order: str, ring: int = 1024) -> DataFrame:
    """Count, whole mean and maximum over all samples; nearest-rank p50, p95, p99, p99.9 over the last `ring` (64 to 8192)."""
    ring = min(8192, max(64, ring))
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    last = samples.withColumn("__n", n).where(F.col("__n") <= ring)
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    recent = last.groupBy(by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), q(0.999).alias("p999"))
    whole = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg(value)).alias("mean"), F.max(value).alias("max"))
    return whole.join(recent, by)


def slow_queries(log: DataFrame, threshold_us: int = 5000) -> DataFrame:
    """Statements at or over the threshold, by fingerprint: calls, total and longest time."""
    slow = log.where(F.col("micros") >= threshold_us).withColumn("statement", fingerprint(F.col("sql")))
    return slow.groupBy("statement").agg(F.count(F.lit(1)).alias("calls"), F.sum("micros").alias("total_micros"), F.max("micros").alias("max_micros"))


def write_load(writes: DataFrame, split_at: int) -> DataFrame:
    """Writes by range, and whether the range should be split."""
    return writes.where("range_id is not null").groupBy("range_id").agg(F.count(F.lit(1)).alias("writes")).withColumn("split", F.col("writes") >= split_at)
