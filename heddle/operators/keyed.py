"""Data structures under keys, as normalised rows: strings, counters, hashes, lists, sets, sorted sets, sketches, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import geo
from heddle.functions.text import stream_id

# --- strings and counters: (key, value, expires_at)


def exists(table: DataFrame, keys: list[str]) -> DataFrame:
    """How many of `keys` there are; a repeated key counts each time."""
    wanted = table.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return wanted.join(table.where(F.col("key").isin(*set(keys))).select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def append(table: DataFrame, key: str, text: str) -> DataFrame:
    """APPEND: the value grows, a missing key starts with it."""
    rows = table.sparkSession.createDataFrame([(key, text)], "key string, tail string")
    both = table.join(rows.withColumnRenamed("key", "__k"), F.col("key") == F.col("__k"), "full")
    value = F.concat(F.coalesce("value", F.lit("")), F.coalesce("tail", F.lit("")))
    return both.select(*[F.coalesce("key", "__k").alias("key") if c == "key" else value.alias("value") if c == "value" else F.col(c) for c in table.columns])


def set_many(table: DataFrame, rows: DataFrame, only: str | None = None) -> DataFrame:
    """SET of (key, value): `only` "nx" for new keys, "xx" for known ones; MSETNX is `only` "all new"."""
    new = rows.select(F.col("key").alias("__k"), F.col("value").alias("__v"))
    if only == "all new" and rows.join(table, "key", "left_semi").limit(1).count():
        return table
    both = table.join(new, F.col("key") == F.col("__k"), "full")
    if only == "xx":
        both = both.where(F.col("key").isNotNull())
    value = F.coalesce("value", "__v") if only == "nx" else F.when(F.col("__k").isNotNull(), F.col("__v")).otherwise(F.col("value"))
    return both.select(*[F.coalesce("key", "__k").alias("key") if c == "key" else value.alias("value") if c == "value" else F.col(c) for c in table.columns])


def get_set(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GETSET of (key, value): (table after, the old value of each key, null if it was missing)."""
    return set_many(table, rows), rows.select("key").join(table.select("key", F.col("value").alias("old")), "key", "left")


def delete(table: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DEL of (key), and GETDEL: (table after, the rows that went)."""
    return table.join(keys.select("key"), "key", "left_anti"), table.join(keys.select("key"), "key", "left_semi")


def get_expire(table: DataFrame, stamps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GETEX of (key, stamp): (table with those keys' new stamps, 0 to persist, the values read)."""
    new = stamps.select(F.col("key").alias("__k"), F.col("stamp").alias("__s"))
    both = table.join(new, F.col("key") == F.col("__k"), "left")
    after = both.withColumn("expires_at", F.coalesce("__s", "expires_at")).select(*table.columns)
    return after, both.where("__k is not null").select("key", "value")


def run_batch(tables: dict[str, DataFrame], commands: list, discard: bool = False) -> dict[str, DataFrame]:
    """MULTI, commands, EXEC: each command takes the tables as the ones before it left them and returns those that it changes.

    A command that raises leaves all tables as they were, as DISCARD does: nothing is kept before the last one.
    """
    if discard:
        return dict(tables)
    after = dict(tables)
    for command in commands:
        after |= command(after)
    return after


def count_up(deltas: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """INCRBY: (key, value) after the sums of `deltas` (key, delta); a sum beyond 64 bits is an error, as ANSI sums are."""
    rows = deltas.select("key", F.col("delta").cast("long").alias("delta"))
    if start is not None:
        rows = rows.unionByName(start.select("key", F.col("value").cast("long").alias("delta")))
    return rows.groupBy("key").agg(F.sum("delta").alias("value"))


def count_up_float(deltas: DataFrame) -> DataFrame:
    """INCRBYFLOAT: a sum that isn't finite is an error."""
    total = F.sum(F.col("delta").cast("double"))
    bad = F.isnan(total) | (F.abs(total) == float("inf"))
    return deltas.groupBy("key").agg(F.when(bad, F.raise_error(F.lit("increment isn't finite"))).otherwise(total).alias("value"))


def expire(stamp: Column, new: Column, only: str | None = None) -> Column:
    """EXPIRE's new stamp: `only` nx, xx, gt, lt compare with the one before, where 0, never, counts as endless."""
    rule = {None: F.lit(True), "nx": stamp == 0, "xx": stamp != 0, "gt": (stamp != 0) & (new > stamp), "lt": (stamp == 0) | (new < stamp)}[only]
    return F.when(rule, new).otherwise(stamp)


# --- hashes: (key, field, value)


def hash_map(rows: DataFrame) -> DataFrame:
    """HGETALL: one map a key, fields in order."""
    return rows.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hash_set(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HSET: (table after, fields added by key)."""
    added = rows.join(table, ["key", "field"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("added"))
    kept = table.join(rows.select("key", "field"), ["key", "field"], "left_anti")
    return kept.unionByName(rows.select(*table.columns)), added


def hash_delete(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HDEL of (key, field): (table after, fields deleted by key)."""
    gone = table.join(rows.select("key", "field").distinct(), ["key", "field"], "left_semi")
    return table.join(rows.select("key", "field"), ["key", "field"], "left_anti"), gone.groupBy("key").agg(F.count(F.lit(1)).alias("deleted"))


# --- lists: (key, pos, value)


def list_slice(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE: positions from start to stop, inclusive; negative ones count from the end."""
    w = Window.partitionBy("key")
    at = F.row_number().over(w.orderBy("pos")) - 1
    return _sliced(rows.withColumn("__at", at).withColumn("__n", F.count(F.lit(1)).over(w)), start, stop)


def _sliced(ranked: DataFrame, start: int, stop: int) -> DataFrame:
    at = lambda i: F.lit(i) if i >= 0 else F.col("__n") + i
    return ranked.where((F.col("__at") >= F.greatest(F.lit(0), at(start))) & (F.col("__at") <= at(stop))).drop("__n").withColumnRenamed("__at", "index")


def push(table: DataFrame, rows: DataFrame, left: bool = False) -> DataFrame:
    """LPUSH or RPUSH of (key, pos, value), in order of pos; the first pushed on the left ends up innermost."""
    w = Window.partitionBy("key").orderBy("pos")
    ends = table.groupBy("key").agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi"))
    n = F.row_number().over(w)
    new = rows.withColumn("__n", n).join(ends, "key", "left")
    pos = F.coalesce("__lo", F.lit(0)) - F.col("__n") if left else F.coalesce("__hi", F.lit(-1)) + F.col("__n")
    return table.unionByName(new.select("key", pos.cast(table.schema["pos"].dataType).alias("pos"), "value"))


def pop(table: DataFrame, key: str, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """LPOP or RPOP: (table after, the popped row)."""
    end = table.where(F.col("key") == key).orderBy(F.col("pos") if left else F.col("pos").desc()).limit(1)
    return table.join(end.select("key", "pos"), ["key", "pos"], "left_anti"), end


# --- sets: (key, member)


def set_add(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SADD: (table after, members added by key)."""
    new = rows.select("key", "member").distinct().join(table, ["key", "member"], "left_anti")
    return table.unionByName(new), new.groupBy("key").agg(F.count(F.lit(1)).alias("added"))


def set_remove(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SREM, ZREM: (table after, members removed by key)."""
    gone = rows.select("key", "member").distinct()
    removed = table.join(gone, ["key", "member"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("removed"))
    return table.join(gone, ["key", "member"], "left_anti"), removed


# --- sorted sets: (key, member, score)


def zset_score(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """ZSCORE of (key, member): the score, null if there is no such member."""
    return wanted.select("key", "member").join(table, ["key", "member"], "left").select("key", "member", "score")


def zset_card(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def zset_add(table: DataFrame, rows: DataFrame, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """ZADD: (table after, members added by key); `only` nx, xx, gt, lt."""
    old, new = table.withColumnRenamed("score", "__old"), rows.select("key", "member", F.col("score").alias("__new"))
    both = old.join(new, ["key", "member"], "full")
    known, given = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    take = {None: given, "nx": given & ~known, "xx": given & known, "gt": given & (~known | (F.col("__new") > F.col("__old"))), "lt": given & (~known | (F.col("__new") < F.col("__old")))}[only]
    after = both.select("key", "member", F.when(take, F.col("__new")).otherwise(F.col("__old")).alias("score")).where("score is not null")
    added = both.where(take & ~known).groupBy("key").agg(F.count(F.lit(1)).alias("added"))
    return after, added


def zset_ranked(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """`rank` from 0 by (score, member); reversed, ties are reversed too.

    Ranks need a key's rows in one order, hence one task a key; ranges and counts by score don't.
    """
    order = [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).cast("long"))


def zset_range(rows: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE by index, inclusive, negatives from the end: `index` is the rank."""
    ranked = zset_ranked(rows, reverse).withColumnRenamed("rank", "__at")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n")) if min(start, stop) < 0 else None
    return _sliced(ranked.join(sizes, "key") if sizes is not None else ranked.withColumn("__n", F.lit(0)), start, stop)


def score_bounds(score: Column, low: str, high: str) -> Column:
    """ZCOUNT's bounds: `(x` is exclusive, -inf and +inf are open."""

    def bound(text: str, inclusive, exclusive):
        value = float(text.lstrip("("))
        return exclusive(value) if text.startswith("(") else inclusive(value)

    return bound(low, lambda v: score >= v, lambda v: score > v) & bound(high, lambda v: score <= v, lambda v: score < v)


def zset_count(rows: DataFrame, low: str, high: str) -> DataFrame:
    return rows.groupBy("key").agg(F.count_if(score_bounds(F.col("score"), low, high)).alias("n"))


def zset_increment(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """ZINCRBY: missing members start at 0."""
    rows = table.select("key", "member", "score").unionByName(deltas.select("key", "member", F.col("delta").alias("score")))
    return rows.groupBy("key", "member").agg(F.sum("score").alias("score"))


# --- distinct counts


def sketch(rows: DataFrame) -> DataFrame:
    """PFADD: one sketch a key, of 2^14 registers, merged from each task's own."""
    return rows.groupBy("key").agg(F.hll_sketch_agg(F.col("member").cast("string"), 14).alias("sketch"))


def sketch_count(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))


def sketch_merge(sketches: DataFrame, destination: str, sources: list[str]) -> DataFrame:
    """PFMERGE: the destination becomes the union of the sources only; its own old sketch doesn't count."""
    merged = sketches.where(F.col("key").isin(*sources)).agg(F.hll_union_agg("sketch").alias("sketch"))
    return sketches.where(F.col("key") != destination).unionByName(merged.select(F.lit(destination).alias("key"), "sketch"))


# --- positions: (key, member, lon, lat)


def geo_search(points: DataFrame, lon: float, lat: float, radius_m: float | None = None, box: tuple[float, float] | None = None, order: str = "score", count: int | None = None, degrees_as_radians: bool = False) -> DataFrame:
    """Members within a radius or a box, with `distance` in metres; by score, or by distance asc or desc (member breaks ties the same way)."""
    at = (F.lit(float(lon)), F.lit(float(lat)))
    out = points.withColumn("distance", geo.haversine(*at, F.col("lon"), F.col("lat")))
    if radius_m is not None:
        reach = radius_m / 111_000.0 * 1.01  # degrees of latitude; a plain bound that the scan can use
        out = out.where(F.col("lat").between(lat - reach, lat + reach) & (F.col("distance") <= radius_m))
    if box is not None:
        out = out.where(geo.in_box(F.col("lon"), F.col("lat"), *at, *box, degrees_as_radians))
    keys = {"score": [geo.score(F.col("lon"), F.col("lat")), F.col("member")], "asc": [F.col("distance"), F.col("member")], "desc": [F.col("distance").desc(), F.col("member").desc()]}[order]
    return out.orderBy(*keys) if count is None else out.orderBy(*keys).limit(min(count, 10_000))


# --- streams: (key, id, fields) with id "ms-seq"


def with_id(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.withColumn("__id", stream_id(F.col(id_col)))


def stream_range(rows: DataFrame, low: str = "-", high: str = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    """XRANGE, XREVRANGE: inclusive bounds, `(` exclusive, `-` and `+` open; COUNT 0 gives nothing, 10,000 is the most."""

    def parsed(text: str, last: bool):
        ms, _, seq = text.lstrip("(").partition("-")
        return F.struct(F.lit(int(ms)).cast("long").alias("ms"), F.lit(int(seq) if seq else ((1 << 63) - 1 if last else 0)).cast("long").alias("seq"))

    out = with_id(rows)
    if low != "-":
        out = out.where(F.col("__id") > parsed(low, False) if low[0] == "(" else F.col("__id") >= parsed(low, False))
    if high != "+":
        out = out.where(F.col("__id") < parsed(high, True) if high[0] == "(" else F.col("__id") <= parsed(high, True))
    if count is not None:
        out = out.orderBy(F.col("__id").desc() if reverse else F.col("__id")).limit(min(max(count, 0), 10_000))
    return out.drop("__id")


def stream_trim(rows: DataFrame, max_len: int | None = None, min_id: str | None = None) -> DataFrame:
    """XTRIM: the newest `max_len` entries of each key, or those from `min_id` on."""
    if min_id is not None:
        return stream_range(rows, min_id)
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.col("__id").desc()))
    return with_id(rows).withColumn("__n", order).where(F.col("__n") <= max_len).drop("__id", "__n")


def stream_rejects(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """XADDs whose id isn't above all ids of the key before them, or is 0-0."""
    w = Window.partitionBy("key").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.struct(F.lit(0).cast("long").alias("ms"), F.lit(0).cast("long").alias("seq"))
    top = F.max("__id").over(w)
    return with_id(rows).withColumn("__top", F.coalesce(top, zero)).where(F.col("__id") <= F.col("__top")).drop("__id", "__top")


def pending(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """Entries delivered to a group and not acknowledged: (key, group, id, consumer, delivered_at, deliveries), the last delivery's consumer."""
    last = deliveries.groupBy("key", "group", "id").agg(F.max_by("consumer", "delivered_at").alias("consumer"), F.max("delivered_at").alias("delivered_at"), F.count(F.lit(1)).alias("deliveries"))
    return last.join(acks.select("key", "group", "id").distinct(), ["key", "group", "id"], "left_anti")


def pending_summary(rows: DataFrame) -> DataFrame:
    """XPENDING: count, least and largest id, and the counts by consumer."""
    by = rows.groupBy("key", "group", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(stream_id(F.col("id"))).alias("lo"), F.max(stream_id(F.col("id"))).alias("hi"))
    text = lambda c: F.concat_ws("-", F.col(f"{c}.ms"), F.col(f"{c}.seq"))
    out = by.groupBy("key", "group").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("consumer", "n"))).alias("consumers"))
    return out.select("key", "group", "n", text("lo").alias("min_id"), text("hi").alias("max_id"), "consumers")


def read_group(entries: DataFrame, cursor: str, consumer: str, count: int, group: str = "g") -> tuple[DataFrame, str]:
    """XREADGROUP `>`: entries after the group's cursor, as deliveries, and the cursor after them."""
    page = with_id(stream_range(entries, f"({cursor}")).orderBy("__id").limit(count)
    last = page.agg(F.max("__id").alias("m")).first().m
    return page.drop("__id").withColumn("group", F.lit(group)).withColumn("consumer", F.lit(consumer)), cursor if last is None else f"{last.ms}-{last.seq}"


def auto_claim(rows: DataFrame, entries: DataFrame, consumer: str, now: int, min_idle: int, start: str = "0-0", count: int = 100) -> tuple[DataFrame, DataFrame]:
    """XAUTOCLAIM: (pending rows claimed for `consumer`, pending rows whose entry is deleted), from `start` on, idle long enough."""
    idle = stream_range(rows, start).where(F.lit(now) - F.col("delivered_at") >= min_idle)
    page = with_id(idle).orderBy("__id").limit(count).drop("__id")
    live = entries.select("key", "id")
    claimed = page.join(live, ["key", "id"], "left_semi").withColumn("consumer", F.lit(consumer)).withColumn("delivered_at", F.lit(now).cast("long")).withColumn("deliveries", F.col("deliveries") + 1)
    return claimed, page.join(live, ["key", "id"], "left_anti")
