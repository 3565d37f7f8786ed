"""Change records: made from two states, numbered, replayed, folded, kept for a while; topics and presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIDE = 1_000_000


class CursorError(LookupError):
    """The cursor points before what is kept ("cursor_expired") or past the end ("cursor_ahead")."""


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(op, pk, before, after) between two states of a table; unchanged rows give none. Rows are structs."""
    rest = [c for c in before.columns if c != key]
    b = before.select(F.col(key).alias("__b"), F.struct(*rest).alias("before"))
    a = after.select(F.col(key).alias("__a"), F.struct(*rest).alias("after"))
    both = b.join(a, F.col("__b") == F.col("__a"), "full").where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("__b").isNull(), "INSERT").when(F.col("__a").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(op.alias("op"), F.coalesce("__b", "__a").alias("pk"), "before", "after")


def sequenced(records: DataFrame, topic: list[str], order: list[str]) -> DataFrame:
    """`sequence` = commit_ts * 1,000,000 + place in the commit: the place starts anew in each commit of a topic."""
    place = F.row_number().over(Window.partitionBy(*topic, "commit_ts").orderBy(*order))
    return records.withColumn("sequence", F.col("commit_ts") * STRIDE + place)


def replay(records: DataFrame, since: int, limit: int, column: str = "commit_ts") -> DataFrame:
    """Records after a commit or a sequence, oldest first; 1 to 100,000 of them."""
    return records.where(F.col(column) > since).orderBy(column, *(["sequence"] if column != "sequence" else [])).limit(min(100_000, max(1, limit)))


def bounds(records: DataFrame, column: str = "sequence") -> DataFrame:
    return records.agg(F.min(column).alias("front"), F.max(column).alias("back"))


def check_cursor(records: DataFrame, cursor: int, column: str = "sequence") -> None:
    """Raise if the cursor's successor isn't kept any more, or the cursor is past the end."""
    front, back = bounds(records, column).first()
    if front is not None and cursor < front - 1:
        raise CursorError("cursor_expired")
    if cursor > (back if back is not None else -1) + 1:
        raise CursorError("cursor_ahead")


def fold(records: DataFrame, key: str = "pk") -> DataFrame:
    """The table after all records: of each key the last one's `after`, unless it was a deletion. Records seen twice don't matter."""
    last = records.groupBy(key).agg(F.max_by(F.struct("op", "after"), "sequence").alias("r"))
    return last.where("r.op <> 'DELETE'").select(key, F.col("r.after").alias("after"))


def keep_last(records: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The newest `n` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return records.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def retained(messages: DataFrame, retention: int) -> DataFrame:
    """A topic's newest messages by partition; retention is 16 to 100,000. Cursors are dense, so a maximum by partition tells the floor, without a sort."""
    n = min(100_000, max(16, retention))
    top = messages.groupBy("partition").agg(F.max("cursor").alias("__top"))
    return messages.join(top, "partition").where(F.col("cursor") > F.col("__top") - n).drop("__top")


def appended(messages: DataFrame, order: str) -> DataFrame:
    """Dense cursors from 0 in each partition of a topic."""
    return messages.withColumn("cursor", (F.row_number().over(Window.partitionBy("partition").orderBy(order)) - 1).cast("long"))


def append_faults(topic: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch (partition, cursor, value) that can't be appended: "conflict" with a kept record of the same cursor, or "gap" after the end.

    Re-appending an identical record is no fault.
    """
    ends = topic.groupBy("partition").agg((F.max("cursor") + 1).alias("__end"))
    kept = topic.select("partition", "cursor", F.col("value").alias("__old"))
    rows = batch.join(kept, ["partition", "cursor"], "left").join(ends, "partition", "left")
    place = F.row_number().over(Window.partitionBy("partition", F.col("__old").isNull()).orderBy("cursor")) - 1
    fault = F.when(F.col("__old").isNotNull() & (F.col("__old") != F.col("value")), "conflict").when(F.col("__old").isNull() & (F.col("cursor") != F.coalesce("__end", F.lit(0)) + place), "gap")
    return rows.withColumn("fault", fault).where("fault is not null").select("partition", "cursor", "value", "fault")


def present(events: DataFrame, now: int, ttl: int) -> DataFrame:
    """Members of each room: the last event is a join that hasn't expired. (room, member, at, kind) in seconds; ttl is 1 to 86,400."""
    ttl = min(86_400, max(1, ttl))
    last = events.where(F.col("at") <= now).groupBy("room", "member").agg(F.max_by("kind", "at").alias("kind"), F.max("at").alias("at"))
    return last.where((F.col("kind") == "join") & (F.col("at") + ttl > now)).select("room", "member", (F.col("at") + ttl).alias("expires_unix"))


def expiry_deletes(table: DataFrame, now_millis: int) -> DataFrame:
    """The sweep: a DELETE record for every expired key."""
    from heddle.functions.expiry import expired

    return table.where(expired(F.col("expires_at"), now_millis)).select(F.lit("DELETE").alias("op"), "key", F.col("value").alias("before"), F.lit(None).cast("string").alias("after"))
