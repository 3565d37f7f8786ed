"""Metering, bills, invoices, latencies, statement rollups, write loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions.text import fingerprint
from heddle.operators import relational as R
from heddle.operators import usage as U
from heddle.plans.base import query
from heddle.session import load

_METRICS = ["read_unit", "write_unit", "stored_byte", "egress_byte", "realtime_message", "connection_minute"]


def usage(spark, d):
    """Metered events: the tenant by user, the metric by id, each third id repeats the one before it, some without a key."""
    e = F.col("event_id")
    metric = F.element_at(F.array(*map(F.lit, _METRICS)), (e % 6 + 1).cast("int"))
    key = F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("k"), F.floor(e / 3).cast("string")))
    return load(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant"), F.lit("main").alias("database"), metric.alias("metric"), (e % 17 + 1).alias("quantity"), key.alias("idempotency_key"), e.alias("seq"))


_U = f"(SELECT 't' || (user_id % 4) AS tenant, 'main' AS database, ({_METRICS})[event_id % 6 + 1] AS metric, event_id % 17 + 1 AS quantity, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'k' || (event_id // 3) END AS idempotency_key, event_id AS seq FROM events)"
_KEPT = f"(SELECT * FROM {_U} WHERE idempotency_key = '' UNION ALL SELECT * FROM (SELECT * FROM {_U} WHERE idempotency_key <> '' QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY seq) = 1))"


@query(f"SELECT tenant, database, metric, sum(quantity)::BIGINT AS quantity, count(*) AS events FROM {_KEPT} GROUP BY 1, 2, 3")
def usage_metering(spark, d):
    return U.metered(usage(spark, d))


@query("SELECT tenant, " + ", ".join(f"coalesce(sum(CASE WHEN metric = '{m}' THEN quantity END), 0)::BIGINT AS {m}" for m in _METRICS) + f" FROM {_KEPT} GROUP BY tenant")
def usage_bills(spark, d):
    return U.bills(U.metered(usage(spark, d)))


@query(f"""SELECT *, quantity * unit_micros AS amount_micros, sum(quantity * unit_micros) OVER ()::BIGINT AS total_micros FROM (
 SELECT metric, sum(quantity)::BIGINT AS quantity, CASE metric WHEN 'write_unit' THEN 5 WHEN 'stored_byte' THEN 0 WHEN 'connection_minute' THEN 10 ELSE 1 END::BIGINT AS unit_micros
 FROM {_KEPT} WHERE tenant = 't1' GROUP BY metric)""")
def usage_invoice(spark, d):
    return U.invoice(U.metered(usage(spark, d)), "t1")


@query("""SELECT w.event_type, n, mean, max, p50, p95, p99, p999 FROM
 (SELECT event_type, count(*) AS n, floor(avg(micros))::BIGINT AS mean, max(micros) AS max FROM (SELECT event_type, (event_id * 7919) % 10007 AS micros FROM events) GROUP BY 1) w JOIN
 (SELECT event_type, quantile_disc(micros, 0.5) AS p50, quantile_disc(micros, 0.95) AS p95, quantile_disc(micros, 0.99) AS p99, quantile_disc(micros, 0.999) AS p999 FROM
  (SELECT event_type, (event_id * 7919) % 10007 AS micros FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 1024) GROUP BY 1) r ON r.event_type = w.event_type""")
def usage_latency(spark, d):
    e = load(spark, d, "events").select("event_type", "event_id", ((F.col("event_id") * 7919) % 10007).alias("micros"))
    return U.latency(e, "event_type", "micros", "event_id")


@query("""SELECT 'SELECT * FROM ' || upper(event_type) || ' WHERE ID = ? AND NAME = ?' AS statement, count(*) AS calls, sum(m)::BIGINT AS total_micros, max(m) AS max_micros
 FROM (SELECT event_type, (event_id * 7919) % 10007 AS m FROM events) WHERE m >= 5000 GROUP BY 1""")
def usage_slow_queries(spark, d):
    e = F.col("event_id")
    sql = F.concat(F.lit("select  * from "), "event_type", F.lit(" where id="), e.cast("string"), F.lit(" and name = 'it"), e.cast("string"), F.lit("'"))
    return U.slow_queries(load(spark, d, "events").select(sql.alias("sql"), ((e * 7919) % 10007).alias("micros")))


@query("SELECT 'INSERT INTO T1 ( A , B ) VALUES ( ? , ? ) ; V1.5' AS f")
def usage_fingerprint(spark, d):
    return spark.createDataFrame([("insert into t1 (a,b)\n values(12, 'x') ; v1.5",)], "s string").select(fingerprint(F.col("s")).alias("f"))


@query("SELECT CASE WHEN o_orderkey < 1000 THEN 1 WHEN o_orderkey < 5000 THEN 2 ELSE 3 END AS range_id, count(*) AS writes, count(*) >= 3000 AS split FROM orders GROUP BY 1")
def usage_write_load(spark, d):
    ranges = spark.createDataFrame([(1, 0, 1000), (2, 1000, 5000), (3, 5000, None)], "range_id int, start long, end long")
    return U.write_load(R.range_lookup(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", ranges, 1000), 3000)
