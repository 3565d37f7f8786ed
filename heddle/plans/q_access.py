"""REST-style reads, the key/value dialect, row security and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import access as A
from heddle.plans import kvsql
from heddle.plans.base import query
from heddle.session import load

_PROFILES = "(SELECT 'p' || c_custkey AS key, to_json({'status': CASE WHEN c_custkey % 3 = 0 THEN 'ready' ELSE 'queued' END, 'score': CAST(c_custkey % 40 AS INT), 'owner': c_mktsegment}) AS value, c_custkey FROM customer)"


def profiles(spark, d):
    k = F.col("c_custkey")
    value = F.to_json(F.struct(F.when(k % 3 == 0, "ready").otherwise("queued").alias("status"), (k % 40).cast("int").alias("score"), F.col("c_mktsegment").alias("owner")))
    return load(spark, d, "customer").select(F.concat(F.lit("p"), k.cast("string")).alias("key"), value.alias("value"))


@query(f"SELECT key, value ->> 'status' AS status FROM {_PROFILES} WHERE value ->> 'status' = 'ready' AND CAST(value ->> 'score' AS DOUBLE) >= 10 ORDER BY key LIMIT 100")
def rest_filter(spark, d):
    return A.rest_read(profiles(spark, d), [("status", "eq.ready"), ("score", "gte.10")], "key,status", "key.asc", json_col="value")


@query(f"SELECT key, value ->> 'score' AS points FROM {_PROFILES} WHERE value ->> 'owner' = 'BUILDING' OR (value ->> 'status' = 'queued' AND CAST(value ->> 'score' AS DOUBLE) < 4) ORDER BY value ->> 'owner' DESC NULLS LAST, key LIMIT 20 OFFSET 3")
def rest_groups_order(spark, d):
    return A.rest_read(profiles(spark, d), [("or", "(owner.eq.BUILDING,and(status.eq.queued,score.lt.4))")], "key,points:score", "owner.desc.nullslast,key", 20, 3, "value")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F') AND NOT (o_orderpriority LIKE '1%') AND o_totalprice <= 90000.5 AND o_orderkey <> 5 AND o_custkey > 3")
def rest_more_operators(spark, d):
    p = [("o_orderstatus", "in.(O,F)"), ("o_orderpriority", "not.like.1*"), ("o_totalprice", "lte.90000.5"), ("o_orderkey", "neq.5"), ("o_custkey", "gt.3")]
    return A.rest_read(load(spark, d, "orders"), p, "o_orderkey,o_orderstatus", limit=None)


@query(f"SELECT count(*) AS count FROM {_PROFILES} WHERE value ->> 'status' = 'queued'")
def rest_count_exact(spark, d):
    return A.rest_count(profiles(spark, d), [("status", "eq.queued")], "value")


@query(f"SELECT key FROM {_PROFILES} WHERE key = 'p77'")
def graphql_key(spark, d):
    return A.graphql_read(profiles(spark, d), '{ profiles(key: "p77") { key } }', "key")


@query("SELECT n_name, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 6")
def graphql_limit(spark, d):
    return A.graphql_read(load(spark, d, "nation"), "{ nation(limit: 6) { n_name n_regionkey } }", "n_nationkey")


_RLS = """(SELECT event_id AS k, CASE event_id % 6 WHEN 0 THEN '{"tenant":"a","v":1}' WHEN 1 THEN '{"Tenant":"a"}' WHEN 2 THEN '{"tenant":"a","TENANT":"a"}' WHEN 3 THEN '{"tenant":7}' WHEN 4 THEN 'plain' ELSE '{"tenant":"b"}' END AS value FROM events)"""


def _rls(spark, d):
    v = F.lit("plain")
    for i, t in ((0, '{"tenant":"a","v":1}'), (1, '{"Tenant":"a"}'), (2, '{"tenant":"a","TENANT":"a"}'), (3, '{"tenant":7}'), (5, '{"tenant":"b"}')):
        v = F.when(F.col("event_id") % 6 == i, t).otherwise(v)
    return load(spark, d, "events").select(F.col("event_id").alias("k"), v.alias("value"))


@query(f"SELECT k FROM {_RLS} WHERE k % 6 IN (0, 1)")
def rls_tenant(spark, d):
    return _rls(spark, d).where(A.tenant_visible(F.col("value"), "tenant", "a")).select("k")


@query(f"SELECT k FROM {_RLS} WHERE k % 6 IN (0, 1) ORDER BY k LIMIT 7")
def rls_before_limit(spark, d):
    return _rls(spark, d).where(A.tenant_visible(F.col("value"), "tenant", "a")).orderBy("k").limit(7).select("k")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 4")
def rls_owner(spark, d):
    policies = [lambda uid: F.col("c_mktsegment") == uid, lambda uid: F.col("c_nationkey") == 4]
    return load(spark, d, "customer").where(A.owner_visible(policies, "BUILDING")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE false")
def rls_default_deny(spark, d):
    return load(spark, d, "customer").where(A.owner_visible([], "BUILDING")).select("c_custkey")


@query("""SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN '{"a":"***","b":{"c":[1,2]}}' ELSE '***' END AS value FROM events""")
def mask_fields(spark, d):
    k = F.col("event_id")
    value = F.when(k % 3 == 0, '{"b":{"c":[1,2]},"a":"secret"}').when(k % 3 == 1, "[1,2]").otherwise("not json")
    return load(spark, d, "events").select(k.alias("k"), A.masked(value, ["a", "missing"]).alias("value"))


_KV = "(SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS value FROM orders)"


def kv(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(k.cast("string").alias("key"), F.when(k % 11 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string")).alias("value"))


def _run(spark, d, sql):
    tags = load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))
    return kvsql.run(sql, {"kv": kv(spark, d), "tags": tags})


@query(f"SELECT * FROM {_KV} WHERE key = '77'")
def kv_point(spark, d):
    return _run(spark, d, "SELECT * FROM kv KEY '77'")


@query(f"SELECT key FROM {_KV} WHERE contains(value, '1-') ORDER BY key DESC LIMIT 10 OFFSET 1")
def kv_contains(spark, d):
    return _run(spark, d, "SELECT KEY FROM kv WHERE VALUE CONTAINS '1-' ORDER BY KEY DESC LIMIT 10 OFFSET 1")


@query(f"SELECT key, value FROM {_KV} WHERE TRY_CAST(value AS DOUBLE) >= 100 AND TRY_CAST(value AS DOUBLE) < 110 AND NOT (key LIKE '1%')")
def kv_where(spark, d):
    return _run(spark, d, "SELECT KEY, VALUE FROM kv WHERE VALUE >= 100 AND VALUE < 110 AND NOT KEY LIKE '1%'")


@query(f"SELECT count(*) AS count, sum(TRY_CAST(value AS DOUBLE)) AS sum, round(avg(TRY_CAST(value AS DOUBLE)), 6) AS avg, max(value) AS max FROM {_KV}")
def kv_aggregates(spark, d):
    return _run(spark, d, "SELECT COUNT(*), SUM(VALUE), AVG(VALUE), MAX(VALUE) FROM kv").withColumn("avg", F.round("avg", 6))


@query(f"SELECT value, count(*) AS count FROM {_KV} GROUP BY value")
def kv_group(spark, d):
    return _run(spark, d, "SELECT VALUE, COUNT(*) FROM kv GROUP BY VALUE")


@query(f"SELECT a.key, a.value AS kv_value, o_orderstatus AS tags_value FROM {_KV} a JOIN orders ON CAST(o_orderkey AS VARCHAR) = a.key")
def kv_join(spark, d):
    return _run(spark, d, "SELECT * FROM kv JOIN tags ON KEY = KEY")


@query(f"SELECT key, CASE WHEN key = '5' THEN 'five' ELSE value END AS value FROM {_KV} UNION ALL SELECT 'fresh', 'row'")
def kv_upsert(spark, d):
    t = {"kv": kv(spark, d)}
    t["kv"] = kvsql.run("UPSERT INTO kv KEY '5' VALUE 'five'", t)
    return kvsql.run("UPSERT INTO kv KEY 'fresh' VALUE 'row'", t)


@query(f"SELECT key, CASE WHEN key = '6' THEN 'six' ELSE value END AS value FROM {_KV} WHERE key <> '5' AND NOT coalesce(value = '7', false)")
def kv_update_delete(spark, d):
    t = {"kv": kv(spark, d)}
    t["kv"] = kvsql.run("DELETE FROM kv KEY '5'", t)
    t["kv"] = kvsql.run("DELETE FROM kv WHERE VALUE = '7'", t)
    return kvsql.run("UPDATE kv KEY '6' SET VALUE 'six'", t)
