"""Change streams: folding records to a table, reactive queries, presence, and event-time windows.

Jobs read a folder of change records as a stream and stop when it is read (`availableNow`), or run on.
State lives in keyed stores, and in deltas and snapshots of Parquet below `folder`, which a cluster's nodes share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heddle.session import remove

CHANGE = "tenant string, database string, branch string, table string, op string, pk string, before string, after string, commit_ts long, tx_id long, sequence long"


def read_changes(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


STATE = "pk string, after string, op string, sequence long"


def _latest(rows: DataFrame) -> DataFrame:
    """Records seen before change nothing: the largest sequence of each key wins. Deletions stay as marks."""
    return rows.groupBy("pk").agg(F.max_by(F.struct("after", "op"), "sequence").alias("r"), F.max("sequence").alias("sequence")).select("pk", "r.after", "r.op", "sequence")


def _stored(spark: SparkSession, folder: str, batch: int, compact_every: int) -> DataFrame:
    """The state's rows after a batch: the snapshot before it and the deltas since, several rows a key."""
    last = (batch + 1) // compact_every * compact_every - 1  # the batch whose end the snapshot is
    paths = [f"{folder}/state/delta={b}" for b in range(last + 1, batch + 1)]
    if last >= 0:
        paths.insert(0, f"{folder}/state/snapshot={last}")
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def fold_stream(changes: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None, compact_every: int = 16, keep_marks: int = 1_000_000_000):
    """Start the fold: every batch writes its own last change of each key as a delta; `each` is called with the live rows.

    Every `compact_every` batches the deltas are folded into a snapshot, and what the snapshot before
    it held goes: old versions, and deletion marks over `keep_marks` sequences (1,000 commits) old. A
    record must not come for the first time later than that. A batch that is run again overwrites its
    own files from those before it, so restarts are exact.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _latest(batch.select("pk", "after", "op", "sequence")).write.mode("overwrite").parquet(f"{folder}/state/delta={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            before = batch_id - compact_every
            deltas = [f"{folder}/state/delta={b}" for b in range(before + 1, batch_id + 1)]
            rows = _latest(spark.read.schema(STATE).parquet(*([f"{folder}/state/snapshot={before}"] if before >= 0 else []), *deltas))
            floor = rows.agg(F.max("sequence").alias("top")).first().top or 0
            rows.where((F.col("op") != "DELETE") | (F.col("sequence") > floor - keep_marks)).write.mode("overwrite").parquet(f"{folder}/state/snapshot={batch_id}")
            if before >= 0:  # of the generation before the one just folded, which a batch run again may still read
                for b in range(before - compact_every, before + 1):
                    remove(spark, f"{folder}/state/delta={b}")
                remove(spark, f"{folder}/state/snapshot={before - compact_every}")
        if each:
            each(live(spark, folder, batch_id, compact_every), batch_id)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def live(spark: SparkSession, folder: str, batch_id: int, compact_every: int = 16) -> DataFrame:
    return _latest(_stored(spark, folder, batch_id, compact_every)).where("op <> 'DELETE'").select("pk", "after", "sequence")


def reactive_query(changes: DataFrame, folder: str, query: Callable[[DataFrame], DataFrame], limit: int = 1000, trigger: dict | None = None):
    """A query's full result after every batch, as frames below `folder`/frames: the first is the snapshot, later ones updates.

    `truncated` tells that the result has reached the limit of 1 to 1,000 rows.
    """
    limit = min(1000, max(1, limit))

    def each(rows: DataFrame, batch_id: int) -> None:
        found = query(rows).limit(limit).select(F.col("pk"), F.col("after").alias("value"))
        frame = found.agg(F.collect_list(F.struct("pk", "value")).alias("rows"))  # at most `limit` rows
        frame.select(F.lit(batch_id).alias("batch"), F.lit("snapshot" if batch_id == 0 else "update").alias("kind"), "rows", (F.size("rows") >= limit).alias("truncated")).write.mode("overwrite").parquet(f"{folder}/frames/batch={batch_id}")

    return fold_stream(changes, folder, each, trigger)


def reactive_view(changes: DataFrame, folder: str, table: str, views: list[tuple[str, str]], limit: int = 1000, trigger: dict | None = None):
    """A reactive query over nested views: `table` names the live rows, each of `views` (name, SQL) may read it and the views before it, and the last one is the query."""

    def query(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        rows.createOrReplaceTempView(table)
        for name, sql in views:
            spark.sql(sql).createOrReplaceTempView(name)
        return spark.table(views[-1][0])

    return reactive_query(changes, folder, query, limit, trigger)


def resume(spark: SparkSession, folder: str, seen: int, kept: int = 16) -> DataFrame:
    """What a consumer that has seen frame `seen` gets: the updates since, or, if some of those are no longer among the `kept` newest, one snapshot of now."""
    all_ = frames(spark, folder)
    last = all_.agg(F.max("batch").alias("b")).first().b
    if last is None or seen >= last - kept:
        return all_.where(F.col("batch") > seen)
    return all_.where(F.col("batch") == last).withColumn("kind", F.lit("snapshot"))


MESSAGE = "channel string, sender string, payload string, commit_ts long, sequence long"


def broadcast(messages: DataFrame, channel: str, at_commit: int = -1) -> DataFrame:
    """A channel's messages to a subscriber that joined at a commit, as they come: no state, and no history before it."""
    return messages.where((F.col("channel") == channel) & (F.col("commit_ts") > at_commit))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/frames/*").orderBy("batch")


PRESENCE = "room string, member string, kind string, at timestamp"


def presence(events: DataFrame, ttl_seconds: int = 30, lateness: str = "0 seconds") -> DataFrame:
    """Joins and leaves of each room's members, with a `leave` when a join's time to live (1 to 86,400 s) passes in event time.

    A join again replaces the one before it. State is a deadline for each member, dropped when it leaves.
    """
    ttl = min(86_400, max(1, ttl_seconds))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        room, member = key
        out = []
        if state.hasTimedOut:
            (deadline,) = state.get
            state.remove()
            yield pd.DataFrame({"room": [room], "member": [member], "kind": ["leave"], "at": [pd.Timestamp(deadline, unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        deadline = state.get[0] if state.exists else None
        for kind, at in zip(rows.kind, rows["at"], strict=True):
            now = at.value // 1_000_000
            if deadline is not None and deadline <= now:
                out.append(("leave", pd.Timestamp(deadline, unit="ms")))
                deadline = None
            if kind == "join":
                if deadline is None:
                    out.append(("join", at))
                deadline = now + ttl * 1000
            elif deadline is not None:
                out.append(("leave", at))
                deadline = None
        if deadline is None:
            if state.exists:
                state.remove()
        else:
            state.update((deadline,))
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"room": room, "member": member, "kind": [k for k, _ in out], "at": pd.Series([a for _, a in out], dtype="datetime64[ns]")})

    return events.withWatermark("at", lateness).groupBy("room", "member").applyInPandasWithState(update, PRESENCE, "deadline long", "append", GroupStateTimeout.EventTimeTimeout)


def expiry_sweep(rows: DataFrame, now_millis: int) -> DataFrame:
    """DELETE records for the stream's expired rows (key, value, expires_at)."""
    from heddle.operators.cdc import expiry_deletes

    return expiry_deletes(rows, now_millis)


def windowed_counts(events: DataFrame, window: str = "1 day", lateness: str = "1 hour", by: str = "event_type", slide: str | None = None) -> DataFrame:
    """An extension, beyond the change streams: event-time windows, sliding if `slide` is given, with a watermark, late rows dropped."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
