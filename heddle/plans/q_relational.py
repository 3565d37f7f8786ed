"""Scans, predicates, joins, aggregates, pages and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions.text import compare
from heddle.operators import relational as R
from heddle.plans import catalog
from heddle.plans.base import query
from heddle.session import load


@query("""
SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
GROUP BY n_name HAVING count(*) > 10 ORDER BY revenue DESC, n_name LIMIT 20
""")
def q_flagship(spark, d):
    lines = load(spark, d, "lineitem").where((F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "1999-01-01"))
    j = lines.join(load(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    g = j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"))
    return g.where("n_lines > 10").orderBy(F.desc("revenue"), "n_name").limit(20)


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def scan_point_lookup(spark, d):
    return R.point_lookup(load(spark, d, "orders"), "o_orderkey", 77)


@query("SELECT * FROM orders WHERE o_orderkey = -5")
def scan_point_lookup_missing(spark, d):
    return R.point_lookup(load(spark, d, "orders"), "o_orderkey", -5)


@query("""
SELECT k.ordinal, k.c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM (VALUES (0, 9), (1, 3), (2, -1), (3, 9), (4, 120)) AS k(ordinal, c_custkey) LEFT JOIN customer USING (c_custkey) ORDER BY ordinal
""")
def scan_multi_get(spark, d):
    return R.multi_get(load(spark, d, "customer"), "c_custkey", [9, 3, -1, 9, 120]).select("ordinal", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25")
def scan_ordered(spark, d):
    return R.ordered_scan(load(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 25)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey > 40 ORDER BY p_partkey LIMIT 25")
def scan_after_cursor(spark, d):
    return R.scan_after(load(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 40, 25)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def scan_key_range(spark, d):
    return R.key_range(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 300)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 300 AND o_orderkey < 100")
def scan_key_range_reversed(spark, d):
    return R.key_range(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 300, 100)


@query("SELECT c_name FROM customer WHERE regexp_matches(c_name, '^.*#0*[1-3]5.?$') ORDER BY c_name LIMIT 10")
def scan_match_page(spark, d):
    k = load(spark, d, "customer").select("c_name")
    return k.where(F.col("c_name").rlike("^.*#0*[1-3]5.?$")).orderBy("c_name").limit(10)


@query("SELECT p_name FROM part WHERE regexp_matches(p_name, '(?s)^[a-m].*[^a-d]$')")
def scan_keys_glob(spark, d):
    return R.match_keys(load(spark, d, "part").select("p_name"), "p_name", "[a-m]*[^a-d]")


@query("SELECT c_name FROM customer WHERE c_name LIKE 'Customer%5' ORDER BY c_name LIMIT 10")
def scan_iterate(spark, d):
    return R.match_keys(load(spark, d, "customer").select("c_name"), "c_name", "Customer*5", count=10)


@query("SELECT sum(strlen(text))::BIGINT AS bytes FROM documents")
def scan_table_bytes(spark, d):
    return R.table_bytes(load(spark, d, "documents"), "text")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders")
def scan_chunks(spark, d):
    return R.chunks(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("SELECT table_name FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) t(table_name)")
def scan_tables(spark, d):
    """The tables that the folder holds."""
    return catalog.tables_in(spark, d)


@query("""SELECT 'lineitem' AS table_name, column_name, (row_number() OVER ())::INT AS ordinal_position,
 CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS data_type, true AS is_nullable FROM (DESCRIBE lineitem)""")
def scan_catalog_columns(spark, d):
    return catalog.columns_of(load(spark, d, "lineitem"), "lineitem")


@query("SELECT o_orderkey AS id, o_orderstatus AS state FROM orders")
def project_alias(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))


@query("SELECT * FROM nation")
def project_star(spark, d):
    return load(spark, d, "nation").select("*")


@query("SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA' ORDER BY r.r_name, n.n_name")
def project_qualified(spark, d):
    n, r = load(spark, d, "nation").alias("n"), load(spark, d, "region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).where(F.col("r.r_name") != "ASIA").orderBy("r.r_name", "n.n_name").select(F.col("n.n_name").alias("nation"), F.col("r.r_name").alias("region"))


@query("SELECT 1 AS one, 'x' AS word, CAST('42' AS BIGINT) AS number, CAST(NULL AS INTEGER) AS nothing, true AS yes")
def project_values(spark, d):
    return spark.sql("SELECT 1 AS one, 'x' AS word, CAST('42' AS BIGINT) AS number, CAST(NULL AS INT) AS nothing, true AS yes")


@query("SELECT * FROM (VALUES ('current_database', 'heddle'), ('current_schema', 'public'), ('current_user', 'heddle'), ('session_user', 'heddle'), ('version', 'heddle 0.1.0')) t(name, value)")
def project_session_values(spark, d):
    return spark.createDataFrame(sorted(catalog.session_values().items()), "name string, value string")


@query("""
SELECT o_orderkey, v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'oops' ELSE CAST(o_orderkey % 13 AS VARCHAR) END AS v FROM orders)
WHERE CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN TRY_CAST(v AS DOUBLE) > 9 ELSE v > '9' END
""")
def where_numeric_aware(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "oops").otherwise((F.col("o_orderkey") % 13).cast("string")).alias("v"))
    return o.where(compare(F.col("v"), ">", F.lit("9")))


@query("SELECT c_custkey FROM customer WHERE (c_acctbal >= 1000 AND c_mktsegment = 'BUILDING') OR c_nationkey < 2 AND c_acctbal <= 0")
def where_and_or(spark, d):
    return load(spark, d, "customer").where(((F.col("c_acctbal") >= 1000) & (F.col("c_mktsegment") == "BUILDING")) | (F.col("c_nationkey") < 2) & (F.col("c_acctbal") <= 0)).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus NOT IN ('F') AND l_quantity BETWEEN 10 AND 12 AND l_tax NOT BETWEEN 0.01 AND 0.05")
def where_in_between(spark, d):
    w = F.col("l_returnflag").isin("R", "A") & ~F.col("l_linestatus").isin("F") & F.col("l_quantity").between(10, 12) & ~F.col("l_tax").between(0.01, 0.05)
    return load(spark, d, "lineitem").where(w).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A_%' AND p_name NOT LIKE 'z%' AND p_brand ILIKE 'bRAND%' AND p_name NOT ILIKE '%QQ%'")
def where_like(spark, d):
    return load(spark, d, "part").where(F.col("p_type").like("%A_%") & ~F.col("p_name").like("z%") & F.col("p_brand").ilike("bRAND%") & ~F.col("p_name").ilike("%QQ%")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM nullif(c_mktsegment, 'MACHINERY') AND nullif(c_nationkey, 3) IS NOT NULL")
def where_distinct_from(spark, d):
    a, b = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))
    return load(spark, d, "customer").where(~a.eqNullSafe(b) & F.nullif(F.col("c_nationkey"), F.lit(3)).isNotNull()).select("c_custkey")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_type = 'click'")
def where_json_path(spark, d):
    page = F.get_json_object("props", "$.k")
    return load(spark, d, "events").where(page.isNotNull() & (F.col("event_type") == "click")).select("event_id", page.alias("k"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 1000 AND s_name <> '$1' AND s_nationkey = 5")
def where_parameters(spark, d):
    load(spark, d, "supplier").createOrReplaceTempView("heddle_supplier")
    sql, args = catalog.bind("SELECT s_suppkey, s_name FROM heddle_supplier WHERE s_acctbal > $2 AND s_name <> '$1' AND s_nationkey = $1 -- $3", [5, 1000])
    return spark.sql(sql, args)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(nullif(c_acctbal, c_acctbal + 0 * c_custkey) > 0, true) OR c_acctbal < 0")
def where_check_violations(spark, d):
    return R.check_violations(load(spark, d, "customer"), F.when(F.col("c_custkey") % 1 == 0, F.col("c_acctbal")) >= 0).select("c_custkey", "c_acctbal")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, d):
    return load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


_SIDES = "SELECT s_suppkey, c_custkey FROM supplier {} JOIN customer ON s_suppkey = c_custkey + 5"


def _sides(spark, d, how):
    s, c = load(spark, d, "supplier").select("s_suppkey"), load(spark, d, "customer").select("c_custkey")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey") + 5, how)


@query(_SIDES.format("LEFT"))
def join_left(spark, d):
    return _sides(spark, d, "left")


@query(_SIDES.format("RIGHT"))
def join_right(spark, d):
    return _sides(spark, d, "right")


@query(_SIDES.format("FULL OUTER"))
def join_full(spark, d):
    return _sides(spark, d, "full")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 200000")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def join_fk_orphans(spark, d):
    return R.orphans(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", load(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), "c_custkey").select("o_orderkey", "o_custkey")


@query("""
SELECT coalesce(n.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE b.c_name END AS c_name
FROM customer b FULL JOIN (SELECT c_custkey * 2 AS c_custkey, 'new ' || c_name AS c_name, c_nationkey < 5 AS deleted FROM customer) n ON b.c_custkey = n.c_custkey
WHERE NOT coalesce(deleted, false)
""")
def join_overlay(spark, d):
    c = load(spark, d, "customer")
    newer = c.select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_nationkey") < 5).alias("deleted"))
    return R.overlay(c.select("c_custkey", "c_name"), newer, "c_custkey")


_RANGES = "(VALUES (1, 0, 100), (2, 100, 450), (3, 600, NULL)) AS r(range_id, a, b)"


@query(f"SELECT o_orderkey, range_id FROM orders LEFT JOIN {_RANGES} ON o_orderkey >= a AND (b IS NULL OR o_orderkey < b)")
def join_range_routing(spark, d):
    ranges = spark.createDataFrame([(1, 0, 100), (2, 100, 450), (3, 600, None)], "range_id int, start long, end long")
    return R.range_lookup(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", ranges, 200).select("o_orderkey", "range_id")


@query("""
SELECT o_orderkey, o_orderdate, max_by(event_id, (ts, event_id)) AS event_id FROM orders LEFT JOIN events ON user_id = o_custkey AND ts <= o_orderdate + INTERVAL 9000 DAY
GROUP BY o_orderkey, o_orderdate
""")
def join_as_of(spark, d):
    """For each order its customer's latest event by then: order times and events are merged in one window by customer."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 9000 DAY")).alias("t"), "o_orderkey", "o_orderdate", F.lit(1).alias("side"), F.lit(None).cast("long").alias("e"))
    e = load(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(None).cast("long").alias("o_orderkey"), F.lit(None).cast("timestamp_ntz").alias("o_orderdate"), F.lit(0).alias("side"), F.col("event_id").alias("e"))
    e = e.withColumn("o_orderdate", F.lit(None).cast(o.schema["o_orderdate"].dataType))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t", "side", "e").rowsBetween(Window.unboundedPreceding, 0)
    return o.unionByName(e).withColumn("event_id", F.last("e", ignorenulls=True).over(w)).where("side = 1").select("o_orderkey", "o_orderdate", "event_id")


@query("SELECT count(*) AS count, count(nullif(l_returnflag, 'N')) AS flagged FROM lineitem")
def agg_count(spark, d):
    return load(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("count"), F.count(F.nullif(F.col("l_returnflag"), F.lit("N"))).alias("flagged"))


_MIXED = "(SELECT o_orderpriority AS g, CASE WHEN o_orderkey % 10 = 0 THEN 'oops' ELSE CAST(o_orderkey AS VARCHAR) END AS v FROM orders)"


def _mixed(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.when(F.col("o_orderkey") % 10 == 0, "oops").otherwise(F.col("o_orderkey").cast("string")).alias("v"))


@query(f"SELECT g, count(v) AS count, sum(TRY_CAST(v AS DOUBLE)) AS sum, round(avg(TRY_CAST(v AS DOUBLE)), 4) AS avg, min(v) AS min, max(v) AS max FROM {_MIXED} GROUP BY g")
def agg_lenient(spark, d):
    v = F.col("v")
    return _mixed(spark, d).groupBy("g").agg(F.count(v).alias("count"), R.lenient_sum(v).alias("sum"), F.round(R.lenient_avg(v), 4).alias("avg"), R.lenient_extreme(v, False).alias("min"), R.lenient_extreme(v).alias("max"))


@query("SELECT count(*) AS count, sum(o_totalprice) AS sum, avg(o_totalprice) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders WHERE o_orderkey < 0")
def agg_empty(spark, d):
    p = F.col("o_totalprice")
    return load(spark, d, "orders").where("o_orderkey < 0").agg(F.count(F.lit(1)).alias("count"), F.sum(p).alias("sum"), F.avg(p).alias("avg"), F.min(p).alias("min"), F.max(p).alias("max"))


@query("SELECT nullif(l_returnflag, 'A') AS flag, count(*) AS count, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def agg_group_with_null(spark, d):
    return load(spark, d, "lineitem").groupBy(F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag")).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS count FROM events GROUP BY 1 HAVING count(*) > 3")
def agg_group_json_having(spark, d):
    return load(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("count")).where("count > 3")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2")
def agg_pricing_summary(spark, d):
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") <= "2001-06-01")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority DESC, o_orderstatus LIMIT 7 OFFSET 2")
def page_distinct(spark, d):
    return R.page(load(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct(), [F.desc("o_orderpriority"), F.asc("o_orderstatus")], 7, 2)


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg ASC NULLS LAST, c_custkey DESC LIMIT 40 OFFSET 15")
def page_nulls_last(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return R.page(c, [F.col("seg").asc_nulls_last(), F.desc("c_custkey")], 40, 15)


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg DESC NULLS FIRST, c_custkey LIMIT 40")
def page_nulls_first(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return R.page(c, [F.col("seg").desc_nulls_first(), F.asc("c_custkey")], 40)


@query("SELECT event_id FROM events ORDER BY json_extract_string(props, '$.k') NULLS LAST, event_id LIMIT 30")
def page_json_order(spark, d):
    return load(spark, d, "events").orderBy(F.get_json_object("props", "$.k").asc_nulls_last(), "event_id").limit(30).select("event_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
def page_limit_zero(spark, d):
    return R.page(load(spark, d, "orders").select("o_orderkey"), [F.asc("o_orderkey")], 0)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def page_top_k(spark, d):
    return R.page(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"


def _ab(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")), load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))


@query(f"{_A} UNION {_B}")
def set_union(spark, d):
    a, b = _ab(spark, d)
    return a.union(b).distinct()


@query(f"{_A} UNION ALL {_B}")
def set_union_all(spark, d):
    a, b = _ab(spark, d)
    return a.union(b)


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, d):
    a, b = _ab(spark, d)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def set_intersect_all(spark, d):
    a, b = _ab(spark, d)
    return a.intersectAll(b)


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_except(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(load(spark, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query(f"{_A} EXCEPT ALL {_B}")
def set_except_all(spark, d):
    a, b = _ab(spark, d)
    return a.exceptAll(b)


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), asia AS (SELECT * FROM nation WHERE n_regionkey = 2) SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM asia) AS nations FROM big GROUP BY o_orderstatus")
def set_cte(spark, d):
    for t in ("orders", "nation"):
        load(spark, d, t).createOrReplaceTempView(f"heddle_{t}")
    return spark.sql("WITH big AS (SELECT * FROM heddle_orders WHERE o_totalprice > 150000), asia AS (SELECT * FROM heddle_nation WHERE n_regionkey = 2) SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM asia) AS nations FROM big GROUP BY o_orderstatus")
