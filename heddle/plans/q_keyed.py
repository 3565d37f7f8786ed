"""Keyed structures: strings, counters, hashes, lists, sets, sorted sets, sketches, positions, streams and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import expiry, geo, hashes
from heddle.operators import keyed as K
from heddle.plans.base import query
from heddle.session import load


def strings(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(k.cast("string").alias("key"), F.col("c_name").alias("value"), F.when(k % 4 == 0, 0).when(k % 4 == 1, k).otherwise((k * 1000).bitwiseOR(F.lit(-(1 << 63)))).alias("expires_at"))


@query("SELECT 3 AS n")
def str_exists(spark, d):
    return K.exists(strings(spark, d), ["5", "5", "x", "9"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, strlen(c_name)::INT AS bytes FROM customer")
def str_length(spark, d):
    return strings(spark, d).select("key", F.octet_length("value").alias("bytes"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey = 7 THEN c_name || '+tail' ELSE c_name END AS value FROM customer UNION ALL SELECT 'none', 'start'")
def str_append(spark, d):
    return K.append(K.append(strings(spark, d).select("key", "value"), "7", "+tail"), "none", "start")


def _new_strings(spark, d):
    return load(spark, d, "supplier").select((F.col("s_suppkey") * 3).cast("string").alias("key"), F.col("s_name").alias("value"))


_S = "(SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer) t"
_N = "(SELECT CAST(s_suppkey * 3 AS VARCHAR) AS key, s_name AS value FROM supplier) n"


@query(f"SELECT coalesce(t.key, n.key) AS key, coalesce(n.value, t.value) AS value FROM {_S} FULL JOIN {_N} ON t.key = n.key")
def str_set_many(spark, d):
    return K.set_many(strings(spark, d).select("key", "value"), _new_strings(spark, d))


@query(f"SELECT coalesce(t.key, n.key) AS key, coalesce(t.value, n.value) AS value FROM {_S} FULL JOIN {_N} ON t.key = n.key")
def str_set_nx(spark, d):
    return K.set_many(strings(spark, d).select("key", "value"), _new_strings(spark, d), "nx")


@query(f"SELECT t.key, coalesce(n.value, t.value) AS value FROM {_S} LEFT JOIN {_N} ON t.key = n.key")
def str_set_xx(spark, d):
    return K.set_many(strings(spark, d).select("key", "value"), _new_strings(spark, d), "xx")


@query(f"SELECT * FROM {_S}")
def str_msetnx_refused(spark, d):
    return K.set_many(strings(spark, d).select("key", "value"), _new_strings(spark, d), "all new")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 4 = 0 THEN -1
 WHEN c_custkey * 1000 <= 60500 THEN -2 ELSE c_custkey * 1000 - 60500 END::BIGINT AS ttl FROM customer""")
def str_ttl(spark, d):
    return strings(spark, d).select("key", expiry.ttl(F.col("expires_at"), 60_500).cast("long").alias("ttl"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 4 = 1 AND 77 > c_custkey THEN 77 WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 4 = 1 THEN c_custkey END AS expires_at FROM customer WHERE c_custkey % 4 < 2")
def str_expire_gt(spark, d):
    s = strings(spark, d).where("expires_at >= 0")
    return s.select("key", K.expire(F.col("expires_at"), F.lit(77).cast("long"), "gt").alias("expires_at"))


@query("SELECT event_type AS key, sum(CASE WHEN user_id % 2 = 0 THEN user_id ELSE -user_id END)::BIGINT AS value FROM events GROUP BY 1")
def count_incr(spark, d):
    u = F.col("user_id")
    return K.count_up(load(spark, d, "events").select(F.col("event_type").alias("key"), F.when(u % 2 == 0, u).otherwise(-u).alias("delta")))


@query("SELECT event_type AS key, round(sum(value), 3) AS value FROM events GROUP BY 1")
def count_incr_float(spark, d):
    return K.count_up_float(load(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").alias("delta"))).withColumn("value", F.round("value", 3))


def _hash(spark, d):
    """user -> event type -> number of events."""
    return load(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("field")).agg(F.count(F.lit(1)).alias("value"))


_H = "(SELECT user_id AS key, event_type AS field, count(*) AS value FROM events GROUP BY 1, 2)"


@query(f"SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields, count(*) AS n FROM {_H} GROUP BY key")
def hash_get_all(spark, d):
    m = K.hash_map(_hash(spark, d))
    return m.select("key", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("fields"), F.size("fields").cast("long").alias("n"))


@query(f"SELECT key, max(CASE WHEN field = 'click' THEN value END) AS clicks, count(CASE WHEN field = 'purchase' THEN 1 END) > 0 AS buys FROM {_H} GROUP BY key")
def hash_get_exists(spark, d):
    return K.hash_map(_hash(spark, d)).select("key", F.try_element_at("fields", F.lit("click")).alias("clicks"), F.map_contains_key("fields", "purchase").alias("buys"))


@query(f"SELECT key, string_agg(field, ',' ORDER BY field) AS keys, string_agg(CAST(value AS VARCHAR), ',' ORDER BY field) AS vals FROM {_H} GROUP BY key")
def hash_keys_values(spark, d):
    m = K.hash_map(_hash(spark, d))
    return m.select("key", F.array_join(F.map_keys("fields"), ",").alias("keys"), F.array_join(F.map_values("fields").cast("array<string>"), ",").alias("vals"))


@query(f"SELECT key, 1::BIGINT AS added FROM {_H} GROUP BY key HAVING count(CASE WHEN field = 'refund' THEN 1 END) = 0")
def hash_set_added(spark, d):
    h = _hash(spark, d)
    return K.hash_set(h, h.select("key", F.lit("refund").alias("field"), F.lit(0).cast("long").alias("value")).distinct())[1]


@query(f"SELECT * FROM {_H} WHERE field <> 'view'")
def hash_delete(spark, d):
    return _hash(spark, d).where("field <> 'view'")


def _list(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))


_L = "(SELECT o_custkey AS key, o_orderkey AS pos, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query(f"SELECT key, i::INT AS index, value FROM {_L} WHERE i >= 1 AND i <= n - 2")
def list_range(spark, d):
    return K.list_slice(_list(spark, d), 1, -2).select("key", F.col("index").cast("int").alias("index"), "value")


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1")
def list_length(spark, d):
    return _list(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT key, pos, value FROM {_L} UNION ALL SELECT key, min(pos) - 1, 'first' FROM {_L} GROUP BY key UNION ALL SELECT key, min(pos) - 2, 'second' FROM {_L} GROUP BY key")
def list_push_left(spark, d):
    t = _list(spark, d)
    keys = t.select("key").distinct()
    rows = keys.select("key", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("first").alias("value")), F.struct(F.lit(1).alias("pos"), F.lit("second").alias("value")))).alias("x")).select("key", F.col("x.pos").cast("long").alias("pos"), "x.value")
    return K.push(t, rows, left=True)


@query(f"SELECT key, pos, value FROM {_L} WHERE key = (SELECT min(o_custkey) FROM orders) AND i = n - 1")
def list_pop_right(spark, d):
    t = _list(spark, d)
    return K.pop(t, t.agg(F.min("key")).first()[0], left=False)[1]


def _set(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct()


@query("SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def set_card(spark, d):
    return _set(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey AS key, string_agg(DISTINCT CAST(l_partkey % 7 AS VARCHAR), ',' ORDER BY CAST(l_partkey % 7 AS VARCHAR)) AS members FROM lineitem GROUP BY 1")
def set_members(spark, d):
    s = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 7).cast("string").alias("member"))
    return s.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members"))


@query("SELECT l_suppkey AS key, 1::BIGINT AS added FROM lineitem GROUP BY 1 HAVING count(CASE WHEN l_partkey = 1 THEN 1 END) = 0")
def set_add_count(spark, d):
    s = _set(spark, d)
    return K.set_add(s, s.select("key", F.lit(1).cast("long").alias("member")))[1]


@query("SELECT l_suppkey AS key, bool_or(l_partkey = 5) AS yes FROM lineitem GROUP BY 1")
def set_is_member(spark, d):
    return _set(spark, d).groupBy("key").agg(F.bool_or(F.col("member") == 5).alias("yes"))


def zset(spark, d):
    """event type -> user -> events, as scores with ties."""
    return load(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).agg(F.count(F.lit(1)).cast("double").alias("score"))


_Z = "(SELECT event_type AS key, CAST(user_id AS VARCHAR) AS member, count(*)::DOUBLE AS score FROM events GROUP BY 1, 2)"


@query(f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM {_Z}")
def zset_rank(spark, d):
    return K.zset_ranked(zset(spark, d))


@query(f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM {_Z}")
def zset_rev_rank(spark, d):
    return K.zset_ranked(zset(spark, d), True)


@query(f"SELECT key, member, score, i::INT AS index FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM {_Z}) WHERE i >= n - 5 AND i <= n - 2")
def zset_range_negative(spark, d):
    return K.zset_range(zset(spark, d), -5, -2).select("key", "member", "score", F.col("index").cast("int").alias("index"))


@query(f"SELECT key, member, score, i::INT AS index FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS i FROM {_Z}) WHERE i <= 3")
def zset_range_reverse(spark, d):
    return K.zset_range(zset(spark, d), 0, 3, True).select("key", "member", "score", F.col("index").cast("int").alias("index"))


@query(f"SELECT key, count(CASE WHEN score > 3 AND score <= 20 THEN 1 END) AS n FROM {_Z} GROUP BY key")
def zset_count_bounds(spark, d):
    return K.zset_count(zset(spark, d), "(3", "20")


@query(f"SELECT key, member, CASE WHEN CAST(member AS INT) % 2 = 0 THEN greatest(score, 5) ELSE score END AS score FROM {_Z}")
def zset_add_gt(spark, d):
    z = zset(spark, d)
    return K.zset_add(z, z.where("cast(member as int) % 2 = 0").withColumn("score", F.lit(5.0)), "gt")[0]


@query(f"SELECT key, member, CASE WHEN CAST(member AS INT) % 3 = 0 THEN score + 2.5 ELSE score END AS score FROM {_Z} UNION ALL SELECT 'fresh', 'm', 2.5")
def zset_incr(spark, d):
    z = zset(spark, d)
    deltas = z.where("cast(member as int) % 3 = 0").select("key", "member", F.lit(2.5).alias("delta")).unionByName(spark.createDataFrame([("fresh", "m", 2.5)], "key string, member string, delta double"))
    return K.zset_increment(z, deltas)


@query("SELECT event_type AS key, true AS within FROM events GROUP BY 1")
def hll_count(spark, d):
    """Whether the sketch's estimate is within 5% of the exact number of users."""
    rows = load(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"))
    exact = rows.groupBy("key").agg(F.countDistinct("member").alias("n"))
    return K.sketch_count(K.sketch(rows)).join(exact, "key").select("key", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("within"))


@query("SELECT key, true AS within FROM (VALUES ('click'), ('view'), ('signup'), ('purchase'), ('error')) t(key)")
def hll_merge(spark, d):
    """`click` becomes the union of view and signup, without its own old members."""
    rows = load(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"))
    merged = K.sketch_merge(K.sketch(rows), "click", ["view", "signup"])
    exact = rows.groupBy("key").agg(F.countDistinct("member").alias("n")).where("key <> 'click'").unionByName(rows.where("key in ('view', 'signup')").agg(F.countDistinct("member").alias("n")).select(F.lit("click").alias("key"), "n"))
    return K.sketch_count(merged).join(exact, "key").select("key", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("within"))


def points(spark, d):
    """Customers at positions that follow from their keys."""
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(F.lit("geo").alias("key"), k.cast("string").alias("member"), ((k * 7919) % 36000 / 100.0 - 180).alias("lon"), ((k * 104729) % 16000 / 100.0 - 80).alias("lat"))


_P = "(SELECT CAST(c_custkey AS VARCHAR) AS member, (c_custkey * 7919) % 36000 / 100.0 - 180 AS lon, (c_custkey * 104729) % 16000 / 100.0 - 80 AS lat FROM customer)"
_H15 = "2 * 6372797.560856 * asin(sqrt(pow(sin(radians(lat - 38.1) / 2), 2) + cos(radians(38.1)) * cos(radians(lat)) * pow(sin(radians(lon - 13.3) / 2), 2)))"


@query(f"SELECT member, round({_H15} / 1000, 3) AS km FROM {_P}")
def geo_distance(spark, d):
    p = points(spark, d)
    return p.select("member", F.round(geo.haversine(F.lit(13.3), F.lit(38.1), F.col("lon"), F.col("lat")) / 1000, 3).alias("km"))


@query(f"SELECT member, round({_H15}, 1) AS metres FROM {_P} WHERE {_H15} <= 3000000 ORDER BY {_H15}, member LIMIT 25")
def geo_radius(spark, d):
    return K.geo_search(points(spark, d), 13.3, 38.1, radius_m=3_000_000, order="asc", count=25).select("member", F.round("distance", 1).alias("metres"))


@query(f"SELECT member FROM {_P} WHERE abs(radians(lon - 13.3) * cos(radians(38.1)) * 6372797.560856) * 2 <= 5000000 AND abs(radians(lat - 38.1) * 6372797.560856) * 2 <= 3000000")
def geo_box(spark, d):
    return K.geo_search(points(spark, d), 13.3, 38.1, box=(5_000_000, 3_000_000)).select("member")


@query(f"SELECT member FROM {_P} WHERE {_H15} <= 2000000 ORDER BY {_H15} DESC, member DESC LIMIT 10")
def geo_radius_desc(spark, d):
    return K.geo_search(points(spark, d), 13.3, 38.1, radius_m=2_000_000, order="desc", count=10).select("member")


_BITS = " + ".join(f"((((floor((lon + 180) / 360 * 67108864)::BIGINT >> {k}) & 1) << {2 * k + 1}) + (((floor((lat + 85.05112878) / 170.10225756 * 67108864)::BIGINT >> {k}) & 1) << {2 * k}))" for k in range(26))


@query(f"SELECT member, {_BITS} AS score FROM {_P}")
def geo_score(spark, d):
    return points(spark, d).select("member", geo.score(F.col("lon"), F.col("lat")).alias("score"))


@query(f"SELECT member, true AS near FROM {_P}")
def geo_position(spark, d):
    """A score's cell holds the position it came from."""
    p = points(spark, d).withColumn("p", geo.decode_score(geo.score(F.col("lon"), F.col("lat"))))
    return p.select("member", ((F.abs(F.col("p.lon") - F.col("lon")) < 1e-5) & (F.abs(F.col("p.lat") - F.col("lat")) < 1e-5)).alias("near"))


_GBITS = " + ".join(f"((((floor((lon + 180) / 360 * 33554432)::BIGINT >> {k}) & 1) << {2 * k + 1}) + (((floor((lat + 90) / 180 * 33554432)::BIGINT >> {k}) & 1) << {2 * k}))" for k in range(25))


@query(f"SELECT member, list_aggregate(list_transform(range(0, 10), lambda k: substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + ((b >> (45 - 5 * k::INT)) & 31)::INT, 1)), 'string_agg', '') || '0' AS hash FROM (SELECT member, {_GBITS} AS b FROM {_P})")
def geo_hash(spark, d):
    return points(spark, d).select("member", geo.geohash(F.col("lon"), F.col("lat")).alias("hash"))


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(c_name) + 1), lambda i: ascii(substr(c_name, i::INT, 1))::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616)"


@query(f"SELECT c_custkey, printf('%016x', h::UBIGINT) AS fnv1a, (h % 16)::INT AS partition FROM (SELECT c_custkey, {_FNV} AS h FROM customer)")
def hash_route(spark, d):
    return load(spark, d, "customer").select("c_custkey", hashes.fnv1a64(F.col("c_name")).alias("fnv1a"), hashes.route(F.col("c_name"), 16).alias("partition"))


def stream(spark, d):
    """event type -> entries at the event's second, several in one second told apart by their sequence."""
    e = load(spark, d, "events")
    return e.select(F.col("event_type").alias("key"), F.concat_ws("-", F.floor(F.col("event_id") / 4).cast("string"), (F.col("event_id") % 4 + 1).cast("string")).alias("id"), "user_id", F.col("event_id").alias("arrival"))


_X = "(SELECT event_type AS key, (event_id // 4) || '-' || (event_id % 4 + 1) AS id, user_id, event_id AS arrival FROM events)"


@query(f"SELECT key, id FROM {_X} WHERE (arrival // 4 > 20 OR (arrival // 4 = 20 AND arrival % 4 + 1 > 2)) AND arrival // 4 <= 90")
def stream_xrange(spark, d):
    return K.stream_range(stream(spark, d), "(20-2", "90").select("key", "id")


@query(f"SELECT key, id FROM {_X} WHERE key = 'click' ORDER BY arrival DESC LIMIT 12")
def stream_xrevrange(spark, d):
    return K.stream_range(stream(spark, d).where("key = 'click'"), count=12, reverse=True).select("key", "id")


@query(f"SELECT key, id FROM {_X} QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC) <= 30")
def stream_trim_len(spark, d):
    return K.stream_trim(stream(spark, d), 30).select("key", "id")


@query(f"SELECT key, count(*) AS n FROM {_X} WHERE arrival // 4 >= 100 GROUP BY key")
def stream_trim_min_id(spark, d):
    return K.stream_trim(stream(spark, d), min_id="100-0").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT key, id, 10 - arrival AS arrival FROM {_X} WHERE arrival < 10 AND key = 'view' AND arrival < (SELECT max(event_id) FROM events WHERE event_type = 'view' AND event_id < 10)")
def stream_rejected(spark, d):
    """Entries that arrive in reverse: all but the first are rejected."""
    s = stream(spark, d).where("arrival < 10 and key = 'view'").withColumn("arrival", 10 - F.col("arrival"))
    return K.stream_rejects(s).select("key", "id", "arrival")


@query(f"SELECT key, id FROM {_X} WHERE key = 'view' AND arrival // 4 > 50 ORDER BY arrival LIMIT 40")
def stream_read(spark, d):
    return K.with_id(K.stream_range(stream(spark, d).where("key = 'view'"), "(50-9223372036854775807")).orderBy("__id").limit(40).select("key", "id")


_DEL = "(SELECT key, id, arrival, 'c' || (user_id % 3) AS consumer FROM " + _X + ")"


def _group(spark, d):
    s = stream(spark, d)
    deliveries = s.select("key", F.lit("g").alias("group"), "id", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"), F.col("arrival").alias("delivered_at"))
    acks = s.where("arrival % 5 <> 0").select("key", F.lit("g").alias("group"), "id")
    return s, K.pending(deliveries, acks)


@query(f"SELECT key, id, consumer, arrival AS delivered_at FROM {_DEL} WHERE arrival % 5 = 0")
def group_pending(spark, d):
    return _group(spark, d)[1].select("key", "id", "consumer", "delivered_at")


@query(f"""SELECT key, count(*) AS n, min_by(id, arrival) AS min_id, max_by(id, arrival) AS max_id,
 (SELECT string_agg(consumer || '=' || c, ',' ORDER BY consumer) FROM (SELECT consumer, count(*) AS c FROM {_DEL} i WHERE i.key = o.key AND i.arrival % 5 = 0 GROUP BY consumer)) AS consumers
 FROM {_DEL} o WHERE arrival % 5 = 0 GROUP BY key""")
def group_pending_summary(spark, d):
    out = K.pending_summary(_group(spark, d)[1])
    return out.select("key", "n", "min_id", "max_id", F.array_join(F.transform("consumers", lambda c: F.concat(c["consumer"], F.lit("="), c["n"].cast("string"))), ",").alias("consumers"))


@query(f"SELECT key, id, 'c9' AS consumer, 2::BIGINT AS deliveries FROM {_DEL} WHERE arrival % 5 = 0 AND arrival <= 400 AND arrival % 3 <> 0 ORDER BY arrival LIMIT 60")
def group_auto_claim(spark, d):
    entries, rows = _group(spark, d)
    live = rows.join(entries.where("arrival % 3 <> 0").select("key", "id"), ["key", "id"], "left_semi")
    return K.auto_claim(live, entries, "c9", 500, 100, count=60)[0].select("key", "id", "consumer", "deliveries")


@query(f"SELECT key, id, 'c1' AS consumer FROM {_X} WHERE key = 'signup' AND arrival // 4 >= 10 ORDER BY arrival LIMIT 15")
def group_read(spark, d):
    page, _ = K.read_group(stream(spark, d).where("key = 'signup'"), "9-9", "c1", 15)
    return page.select("key", "id", "consumer")


@query("SELECT event_type AS key, count(*) AS length, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def stream_info(spark, d):
    return stream(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))


@query(f"SELECT key, id FROM {_X} WHERE arrival % 2 = 0")
def stream_delete(spark, d):
    s = stream(spark, d)
    return s.join(s.where("arrival % 2 = 1").select("key", "id"), ["key", "id"], "left_anti").select("key", "id")


@query(f"SELECT n.key, t.value AS old FROM {_N} LEFT JOIN {_S} ON t.key = n.key")
def str_get_set(spark, d):
    return K.get_set(strings(spark, d).select("key", "value"), _new_strings(spark, d))[1]


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value, CASE WHEN c_nationkey < 5 THEN 99 ELSE 0 END::BIGINT AS expires_at FROM customer")
def str_get_expire(spark, d):
    """GETEX gives some keys a stamp and persists the others."""
    c = load(spark, d, "customer")
    stamps = c.select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_nationkey") < 5, 99).otherwise(0).cast("long").alias("stamp"))
    after, read = K.get_expire(strings(spark, d).withColumn("expires_at", F.col("expires_at").cast("long")), stamps)
    return after.join(read.select("key"), "key", "left_semi")


@query(f"SELECT 'left' AS what, count(*) AS n FROM {_S} WHERE key NOT IN (SELECT key FROM {_N}) UNION ALL SELECT 'deleted', count(*) FROM {_S} WHERE key IN (SELECT key FROM {_N})")
def str_delete(spark, d):
    """DEL, and GETDEL, which returns what goes."""
    after, gone = K.delete(strings(spark, d).select("key", "value"), _new_strings(spark, d))
    return after.agg(F.lit("left").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(gone.agg(F.lit("deleted").alias("what"), F.count("value").alias("n")))


@query(f"SELECT key, count(*) AS deleted FROM {_H} WHERE field IN ('view', 'error') GROUP BY key")
def hash_delete_count(spark, d):
    h = _hash(spark, d)
    return K.hash_delete(h, h.select("key").distinct().withColumn("field", F.explode(F.array(F.lit("view"), F.lit("error"), F.lit("nothing")))))[1]


@query(f"SELECT key, pos, value FROM {_L} UNION ALL SELECT key, max(pos) + 1, 'first' FROM {_L} GROUP BY key UNION ALL SELECT key, max(pos) + 2, 'second' FROM {_L} GROUP BY key")
def list_push_right(spark, d):
    t = _list(spark, d)
    rows = t.select("key").distinct().withColumn("x", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("first").alias("value")), F.struct(F.lit(1).alias("pos"), F.lit("second").alias("value")))))
    return K.push(t, rows.select("key", F.col("x.pos").cast("long").alias("pos"), "x.value"))


@query(f"SELECT key, pos, value FROM {_L} WHERE key = (SELECT min(o_custkey) FROM orders) AND i = 0")
def list_pop_left(spark, d):
    t = _list(spark, d)
    return K.pop(t, t.agg(F.min("key")).first()[0])[1]


@query("SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS removed FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1")
def set_remove(spark, d):
    s, small = _set(spark, d), load(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("member"))
    return K.set_remove(s, s.join(small, "member", "left_semi"))[1]


@query(f"SELECT key, count(*) AS n FROM {_Z} WHERE score > 3 GROUP BY key")
def zset_remove_card(spark, d):
    """ZREM of the low scores, then ZCARD."""
    z = zset(spark, d)
    return K.zset_card(K.set_remove(z, z.where("score <= 3"))[0])


@query(f"SELECT k.key, k.member, z.score FROM (SELECT DISTINCT event_type AS key, m AS member FROM events, (VALUES ('1'), ('2'), ('nobody')) v(m)) k LEFT JOIN {_Z} z ON z.key = k.key AND z.member = k.member")
def zset_score(spark, d):
    z = zset(spark, d)
    wanted = z.select("key").distinct().withColumn("member", F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("nobody"))))
    return K.zset_score(z, wanted)


@query(f"SELECT 'after' AS what, coalesce(t.key, n.key) AS key, coalesce(n.value, t.value) || '!' AS value FROM {_S} FULL JOIN {_N} ON t.key = n.key UNION ALL SELECT 'discarded', key, value FROM {_S}")
def exec_batch(spark, d):
    """MULTI, a SET and an APPEND to what it left, EXEC; a batch that is discarded, or whose last command fails, changes nothing."""
    tables = {"s": strings(spark, d).select("key", "value")}
    commands = [lambda t: {"s": K.set_many(t["s"], _new_strings(spark, d))}, lambda t: {"s": t["s"].withColumn("value", F.concat("value", F.lit("!")))}]

    def fails(t):
        raise ValueError("wrong kind of value")

    try:
        K.run_batch(tables, [*commands, fails])
        raise AssertionError("the batch went through")
    except ValueError:
        pass
    after, same = K.run_batch(tables, commands)["s"], K.run_batch(tables, commands, discard=True)["s"]
    return after.select(F.lit("after").alias("what"), "*").unionByName(same.select(F.lit("discarded").alias("what"), "*"))


@query(f"SELECT member, format('{{:.4f}}', {_H15}) AS m, format('{{:.4f}}', {_H15} / 1000) AS km, format('{{:.4f}}', {_H15} / 1609.344) AS mi, format('{{:.4f}}', {_H15} / 0.3048) AS ft FROM {_P}")
def geo_distance_units(spark, d):
    metres = geo.library_haversine(F.lit(13.3), F.lit(38.1), F.col("lon"), F.col("lat"))
    p = points(spark, d).select("member", metres.alias("metres"))
    return p.select("member", *[geo.distance_text(F.col("metres"), u).alias(u) for u in ("m", "km", "mi", "ft")])
