"""Data changes, constraints and schema changes, as tables after."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import dml as M
from heddle.operators import relational as R
from heddle.plans.base import query
from heddle.session import load


def _t(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


_T = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer)"


@query(f"SELECT * FROM {_T} UNION ALL SELECT -s_suppkey - 1, s_name, 7, NULL FROM supplier")
def dml_insert_select(spark, d):
    rows = load(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return M.insert(_t(spark, d), rows, ["c_custkey"], {"c_nationkey": F.lit(7)})


#: A row for every customer under twice its key: half of the keys are known, half are new.
_NEW = "(SELECT c_custkey * 2 AS c_custkey, 'new' AS c_name, CAST(9 AS INT) AS c_nationkey, c_acctbal + 1 AS c_acctbal FROM customer)"


def _new(spark, d):
    return load(spark, d, "customer").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(9).alias("c_nationkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"))


@query(f"SELECT * FROM {_T} UNION ALL SELECT * FROM {_NEW} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_T})")
def dml_insert_ignore(spark, d):
    return M.insert_ignore(_t(spark, d), _new(spark, d), ["c_custkey"])


@query(f"SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM {_T} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey")
def dml_upsert(spark, d):
    return M.upsert(_t(spark, d), _new(spark, d), ["c_custkey"])


@query(f"""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN n.c_name ELSE o.c_name END AS c_name,
CASE WHEN o.c_custkey IS NULL THEN n.c_nationkey WHEN n.c_custkey IS NOT NULL AND o.c_nationkey > 5 THEN o.c_nationkey + n.c_nationkey ELSE o.c_nationkey END AS c_nationkey,
CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NOT NULL AND o.c_nationkey > 5 THEN greatest(o.c_acctbal, 0) ELSE o.c_acctbal END AS c_acctbal
FROM {_T} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey""")
def dml_on_conflict_update(spark, d):
    assign = {"c_nationkey": F.col("old.c_nationkey") + F.col("new.c_nationkey"), "c_acctbal": F.greatest(F.col("old.c_acctbal"), F.lit(0.0))}
    return M.upsert(_t(spark, d), _new(spark, d), ["c_custkey"], assign, F.col("old.c_nationkey") > 5)


@query(f"SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_nationkey = 3 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_nationkey = 3 THEN least(coalesce(c_acctbal, 0), 100) ELSE c_acctbal END AS c_acctbal FROM {_T}")
def dml_update_where(spark, d):
    return M.update_where(_t(spark, d), F.col("c_nationkey") == 3, {"c_name": F.concat("c_name", F.lit("!")), "c_nationkey": F.col("c_nationkey") + 1, "c_acctbal": F.least(F.coalesce("c_acctbal", F.lit(0.0)), F.lit(100.0))})


@query(f"SELECT c_custkey, coalesce(n_name, c_name) AS c_name, c_nationkey, c_acctbal FROM {_T} t LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON n_nationkey = c_nationkey")
def dml_update_from(spark, d):
    return M.update_from(_t(spark, d), load(spark, d, "nation").where("n_regionkey = 1"), F.col("t.c_nationkey") == F.col("s.n_nationkey"), {"c_name": F.col("s.n_name")}, ["c_custkey"])


@query(f"SELECT * FROM {_T} WHERE c_acctbal >= 0 AND c_nationkey <> 4")
def dml_delete_where(spark, d):
    return M.delete_where(_t(spark, d), (F.col("c_acctbal") < 0) | (F.col("c_nationkey") == 4))


_USING = "c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"


@query(f"SELECT * FROM {_T} WHERE NOT ({_USING})")
def dml_delete_using(spark, d):
    return M.delete_using(_t(spark, d), load(spark, d, "orders").where("o_totalprice > 250000"), F.col("t.c_custkey") == F.col("s.o_custkey"))[0]


@query(f"SELECT c_custkey, c_name FROM {_T} WHERE {_USING}")
def dml_delete_returning(spark, d):
    return M.delete_using(_t(spark, d), load(spark, d, "orders").where("o_totalprice > 250000"), F.col("t.c_custkey") == F.col("s.o_custkey"))[1].select("c_custkey", "c_name")


@query("""SELECT c_custkey, '{"a":"1","b":"' || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'old' END || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"c":"' || c_custkey || '"' ELSE '' END || '}' AS doc FROM customer""")
def dml_patch_merge(spark, d):
    k = F.col("c_custkey")
    change = F.when(k % 2 == 0, F.to_json(F.struct(F.lit("x").alias("b"), k.cast("string").alias("c")))).otherwise("{}")
    return load(spark, d, "customer").select("c_custkey", M.patch(F.lit('{"a":"1","b":"old"}'), change).alias("doc"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def ddl_unique_violations(spark, d):
    return R.duplicates(load(spark, d, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS full_name, c_nationkey, 'active' AS state FROM customer")
def ddl_alter(spark, d):
    t = load(spark, d, "customer")
    return M.alter(t, {"state": F.lit("active")}, ["c_acctbal", "c_mktsegment"], {"c_custkey": "id", "c_name": "full_name"}, {"id": "string"}, ["id"])


_GONE = "(SELECT c_custkey FROM customer WHERE c_nationkey = 2)"


def _gone(spark, d):
    return load(spark, d, "customer").where("c_nationkey = 2")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN {_GONE}")
def fk_cascade(spark, d):
    return M.cascade(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", _gone(spark, d), "c_custkey")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN {_GONE})")
def fk_cascade_chain(spark, d):
    orders = load(spark, d, "orders")
    gone_orders = orders.join(_gone(spark, d), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return M.cascade(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", gone_orders, "o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN o_custkey IN {_GONE} THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def fk_set_null(spark, d):
    return M.cascade(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", _gone(spark, d), "c_custkey", "set null")


@query(f"SELECT o_orderkey, CASE WHEN o_custkey IN {_GONE} THEN 0 ELSE o_custkey END AS o_custkey FROM orders")
def fk_set_default(spark, d):
    return M.cascade(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", _gone(spark, d), "c_custkey", "set default", F.lit(0))


@query("SELECT r_name, n FROM (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1) v JOIN region ON r_regionkey = n_regionkey")
def ddl_nested_views(spark, d):
    load(spark, d, "nation").where("n_nationkey > 3").createOrReplaceTempView("heddle_v1")
    spark.sql("SELECT n_regionkey, count(*) AS n FROM heddle_v1 GROUP BY 1").createOrReplaceTempView("heddle_v2")
    load(spark, d, "region").createOrReplaceTempView("heddle_region")
    return spark.sql("SELECT r_name, n FROM heddle_v2 JOIN heddle_region ON r_regionkey = n_regionkey")
