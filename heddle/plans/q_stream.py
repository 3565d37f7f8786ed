"""Structured Streaming jobs, run until their input is read, and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.plans.base import query
from heddle.plans.q_versions import _R, records
from heddle.session import load
from heddle.session import scratch as _folder
from heddle.streaming import jobs


def _change_files(spark, d, parts: int = 3) -> str:
    """The change records of topic click as files that come in order of sequence, overlapping by a commit."""
    r = records(spark, d).where("topic = 'click'")
    rows = r.select(F.lit("t").alias("tenant"), F.lit("main").alias("database"), F.lit("main").alias("branch"), F.lit("users").alias("table"), "op", F.col("pk").cast("string").alias("pk"), F.lit(None).cast("string").alias("before"), "after", "commit_ts", F.lit(0).cast("long").alias("tx_id"), "sequence")
    path, top = _folder(spark), r.agg(F.max("commit_ts")).first()[0] or 0
    for i in range(parts):
        low, high = top * i // parts, top * (i + 1) // parts
        rows.where((F.col("commit_ts") >= low) & (F.col("commit_ts") <= high)).write.mode("append").parquet(path)
    return path


_FOLDED = f"SELECT CAST(pk AS VARCHAR) AS pk, after FROM (SELECT * FROM {_R} WHERE topic = 'click' QUALIFY row_number() OVER (PARTITION BY pk ORDER BY sequence DESC) = 1) WHERE op <> 'DELETE'"


@query(_FOLDED)
def stream_fold(spark, d):
    """The table after a stream of changes, some of them delivered twice, one file a batch."""
    state, last = _folder(spark), []
    q = jobs.fold_stream(jobs.read_changes(spark, _change_files(spark, d), 1), state, lambda rows, b: last.append(b))
    q.awaitTermination()
    return jobs.live(spark, state, last[-1]).select("pk", "after")


@query(f"SELECT pk, after FROM ({_FOLDED}) ORDER BY after, pk LIMIT 20")
def stream_reactive_query(spark, d):
    """The last frame of a query that is evaluated anew, in full, after every batch."""
    state = _folder(spark)
    q = jobs.reactive_query(jobs.read_changes(spark, _change_files(spark, d), 1), state, lambda t: t.orderBy("after", "pk"), 20)
    q.awaitTermination()
    last = jobs.frames(spark, state).orderBy(F.desc("batch")).limit(1)
    return last.select(F.explode("rows").alias("r")).select("r.pk", F.col("r.value").alias("after"))


def _views(v: str):
    return [("heddle_early", f"SELECT * FROM {v} WHERE pk < '5'"), ("heddle_early_values", "SELECT pk, after FROM heddle_early WHERE after IS NOT NULL ORDER BY pk")]


@query(f"SELECT pk, after FROM ({_FOLDED}) WHERE pk < '5' ORDER BY pk LIMIT 30")
def stream_reactive_view(spark, d):
    """A query over a view of a view is evaluated anew when the base table changes."""
    state = _folder(spark)
    jobs.reactive_view(jobs.read_changes(spark, _change_files(spark, d), 1), state, "heddle_live", _views("heddle_live"), 30).awaitTermination()
    last = jobs.frames(spark, state).orderBy(F.desc("batch")).limit(1)
    return last.select(F.explode("rows").alias("r")).select("r.pk", F.col("r.value").alias("after"))


@query(f"SELECT 'snapshot' AS kind, pk, after FROM (SELECT * FROM ({_FOLDED}) ORDER BY after, pk LIMIT 20) UNION ALL SELECT 'update', pk, after FROM (SELECT * FROM ({_FOLDED}) ORDER BY after, pk LIMIT 20)")
def stream_lag_recovery(spark, d):
    """A consumer far behind gets the current snapshot; one that has missed only the last frame gets that update."""
    state = _folder(spark)
    jobs.reactive_query(jobs.read_changes(spark, _change_files(spark, d), 1), state, lambda t: t.orderBy("after", "pk"), 20).awaitTermination()
    newest = jobs.frames(spark, state).agg(F.max("batch")).first()[0]
    both = jobs.resume(spark, state, -1, kept=1).unionByName(jobs.resume(spark, state, newest - 1, kept=1))
    return both.select("kind", F.explode("rows").alias("r")).select("kind", "r.pk", F.col("r.value").alias("after"))


@query("SELECT user_id::VARCHAR AS sender, props AS payload, event_id AS sequence FROM events WHERE event_type = 'click' AND event_id // 8 > 20")
def stream_broadcast(spark, d):
    """Messages fan out as they come, to a subscriber of one channel that joined at a commit."""
    path, out = _folder(spark), _folder(spark)
    e = load(spark, d, "events")
    e.select(F.col("event_type").alias("channel"), F.col("user_id").cast("string").alias("sender"), F.col("props").alias("payload"), F.floor(F.col("event_id") / 8).alias("commit_ts"), F.col("event_id").alias("sequence")).write.parquet(path)
    stream = jobs.broadcast(spark.readStream.schema(jobs.MESSAGE).parquet(path), "click", 20)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.MESSAGE).parquet(f"{out}/rows").select("sender", "payload", "sequence")


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS member, CASE WHEN event_id % 4 = 0 THEN 'leave' ELSE 'join' END AS kind, epoch_us(ts) // 1000 + event_id AS t FROM events WHERE event_type = 'signup'),
o AS (SELECT *, lag(kind) OVER w AS last_kind, lag(t) OVER w AS last_t, lead(t) OVER w AS next_t FROM e WINDOW w AS (PARTITION BY member ORDER BY t)),
s AS (SELECT *, last_kind = 'join' AND last_t + 3600000 > t AS there, max(t) OVER () AS newest FROM o)
SELECT member, 'leave' AS kind, last_t + 3600000 AS at FROM s WHERE last_kind = 'join' AND last_t + 3600000 <= t
UNION ALL SELECT member, 'join', t FROM s WHERE kind = 'join' AND NOT coalesce(there, false)
UNION ALL SELECT member, 'leave', t FROM s WHERE kind = 'leave' AND coalesce(there, false)
UNION ALL SELECT member, 'leave', t + 3600000 FROM s WHERE kind = 'join' AND next_t IS NULL AND t + 3600000 < newest
""")
def stream_presence(spark, d):
    """Presence over a file stream: who joins and leaves when, by their own doing or as an hour has passed in event time."""
    path, out = _folder(spark), _folder(spark)
    e = load(spark, d, "events").where("event_type = 'signup'")
    at = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id"))
    e.select(F.lit("r").alias("room"), F.col("user_id").cast("string").alias("member"), F.when(F.col("event_id") % 4 == 0, "leave").otherwise("join").alias("kind"), at.alias("at")).write.parquet(path)
    stream = spark.readStream.schema(jobs.PRESENCE).parquet(path)
    jobs.presence(stream, 3600).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.PRESENCE).parquet(f"{out}/rows").select("member", "kind", F.unix_millis("at").alias("at"))


@query("""
SELECT window_start AS day, event_type, count(*) AS n FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 12 HOUR, date_trunc('day', ts) - INTERVAL 12 HOUR]) AS window_start FROM events)
WHERE ts >= window_start AND ts < window_start + INTERVAL 1 DAY GROUP BY 1, 2
""")
def window_sliding(spark, d):
    """An extension: windows of a day that start every twelve hours, in batch."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(e, slide="12 hours").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def window_late_rows(spark, d):
    """An extension: windows of a stream, in append mode; rows that come after the watermark has passed their window are dropped."""
    path, out = _folder(spark), _folder(spark)
    e = load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2)
    parts = [e.where(F.col("ts") < middle), e.where(F.col("ts") >= middle), e.where(F.col("ts") < F.lit(first) + F.expr("INTERVAL 2 DAYS"))]
    for i, part in enumerate(parts):  # a file a part, read in this order; the last one is late
        part.coalesce(1).write.parquet(f"{path}/p={i}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    counted = jobs.windowed_counts(stream)
    counted.select(F.col("w.start").alias("day"), "event_type", "n").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    """An extension: tumbling windows of a day, in batch."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(e).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s
""")
def window_session(spark, d):
    """An extension: sessions with a gap of two hours."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
