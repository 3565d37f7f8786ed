"""Tables, constraints, indexes, sequences, triggers, views, branches: what statements leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import json as J
from heddle.operators import branches as B
from heddle.operators import dml as M
from heddle.plans import catalog
from heddle.plans.base import query
from heddle.plans.q_sources import _folder
from heddle.plans.q_versions import _V, log
from heddle.session import load


def _refused(statement) -> bool:
    """If a statement fails as one of the catalogue's."""
    try:
        statement()
    except (catalog.CatalogError, M.ConflictError):
        return True
    return False


def _shop(spark, d) -> catalog.Database:
    """Customers and their orders, with keys."""
    db = catalog.Database(spark)
    db.create_table("customer", load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), primary=("c_custkey",))
    db.create_table("orders", load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), primary=("o_orderkey",))
    return db


@query("SELECT * FROM (VALUES ('again', true), ('again, if not exists', false), ('drop', false), ('drop again', true), ('drop again, if exists', false), ('kept rows', true)) t(step, refused)")
def ddl_create_drop(spark, d):
    """CREATE and DROP TABLE with and without IF [NOT] EXISTS."""
    db = _shop(spark, d)
    steps = [("again", _refused(lambda: db.create_table("orders", "x int"))), ("again, if not exists", _refused(lambda: db.create_table("orders", "x int", if_not_exists=True)))]
    steps.append(("kept rows", db.tables["orders"].rows.count() == load(spark, d, "orders").count()))
    steps += [("drop", _refused(lambda: db.drop_table("orders"))), ("drop again", _refused(lambda: db.drop_table("orders"))), ("drop again, if exists", _refused(lambda: db.drop_table("orders", if_exists=True)))]
    return spark.createDataFrame(steps, "step string, refused boolean")


_LISTED = """
SELECT 'orders' AS table_name, kind, name, definition FROM (VALUES ('column', 'o_custkey', 'bigint'), ('column', 'o_orderkey', 'bigint'), ('column', 'o_orderstatus', 'string'), ('primary', 'orders_pkey', 'o_orderkey'),
 ('foreign', 'orders_fk', 'o_custkey -> customer(c_custkey) on delete cascade on update restrict'), ('check', 'known_state', ''), ('index', 'by_state', 'o_orderstatus,o_custkey')) t(kind, name, definition)
"""


@query(_LISTED)
def ddl_constraints_indexes(spark, d):
    """Constraints that the rows keep are added, one that they break is refused, one is dropped; indexes are listed."""
    db = _shop(spark, d)
    gone = load(spark, d, "orders").select("o_custkey").join(db.tables["customer"].rows, F.col("o_custkey") == F.col("c_custkey"), "left_anti").isEmpty()
    if not gone:  # orders of unknown customers would break the key
        db.tables["orders"].rows = db.tables["orders"].rows.join(db.tables["customer"].rows, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    db.add_constraint("orders", "orders_fk", catalog.Constraint("foreign", ("o_custkey",), parent="customer", parent_columns=("c_custkey",), on_delete="cascade"))
    db.add_constraint("orders", "known_state", catalog.Constraint("check", check=F.col("o_orderstatus").isin("O", "F", "P")))
    db.add_constraint("orders", "pair", catalog.Constraint("unique", ("o_orderkey", "o_custkey")))
    db.drop_constraint("orders", "pair")
    assert _refused(lambda: db.add_constraint("orders", "one_each", catalog.Constraint("unique", ("o_custkey",))))
    assert _refused(lambda: db.drop_table("customer"))
    db.create_index("orders", "by_state", ("o_orderstatus", "o_custkey"))
    assert _refused(lambda: db.create_index("orders", "one_customer", ("o_custkey",), unique=True))
    return db.listing().where("table_name = 'orders'")


@query("SELECT page, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS page FROM events) GROUP BY 1")
def ddl_index_json_path(spark, d):
    """An index over a JSON path is kept as metadata; its expression groups the rows."""
    db = catalog.Database(spark)
    db.create_table("events", load(spark, d, "events").select("event_id", "props"))
    db.create_index("events", "by_key", ("get_json_object(props, '$.k')",))
    (expression,) = db.tables["events"].indexes["by_key"][1]
    return db.tables["events"].rows.groupBy(F.expr(expression).alias("page")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) * 5 + 95 AS id, c_name AS name, 'new' AS state, TIMESTAMP '2024-05-01' AS made FROM customer UNION ALL SELECT count(*) * 5 + 100, NULL, 'new', TIMESTAMP '2024-05-01' FROM customer")
def dml_insert_defaults(spark, d):
    """Rows in one statement, then DEFAULT VALUES: an identity that counts by 5 from 100, a default, and a trigger's stamp."""
    db = catalog.Database(spark)
    db.create_table("t", "id long, name string, state string, made timestamp_ntz", primary=("id",), defaults={"state": F.lit("new")}, identity={"id": catalog.Sequence(5, start=100)})
    db.create_trigger("t", "made")
    now = F.lit("2024-05-01").cast("timestamp_ntz")
    rows = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")).orderBy("c_custkey")
    db.insert("t", rows, now)
    db.insert("t", None, now)
    return db.tables["t"].rows


@query("SELECT n, 'seq' AS name FROM (VALUES (-1), (-2), (7), (8), (1), (2), (3), (1)) t(n)")
def sequence_values(spark, d):
    """nextval of a descending sequence, after setval with and without `called`, and of one that cycles."""
    down, up, circle = catalog.Sequence(-1), catalog.Sequence(), catalog.Sequence(maximum=3, cycle=True)
    out = [down.nextval(), down.nextval()]
    up.setval(7, False)
    out += [up.nextval(), up.setval(7) and up.nextval()]
    out += [circle.nextval() for _ in range(4)]
    assert down.currval() == -2 and circle.currval() == 1
    return spark.createDataFrame([(n, "seq") for n in out], "n int, name string")


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END AS updated FROM customer")
def trigger_stamps(spark, d):
    """BEFORE UPDATE: the rows that an update touches take its time, the others keep theirs."""
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    t = M.stamped(load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "updated", at("2024-01-01"))
    return M.update_where(t, F.col("c_nationkey") < 5, {"updated": at("2024-06-01")}).drop("c_nationkey")


@query("SELECT o_orderstatus AS state, count(*) AS before, count(*) * 2 AS after FROM orders GROUP BY 1")
def view_materialized(spark, d):
    """A materialised view WITH NO DATA, populated, keeps its rows while its table changes, until it is refreshed."""
    load(spark, d, "orders").createOrReplaceTempView("heddle_mv_orders")
    view = catalog.MaterializedView(spark, "heddle_mv", "SELECT o_orderstatus AS state, count(*) AS n FROM heddle_mv_orders GROUP BY 1", _folder(spark), with_data=False)
    try:
        view.read()
        raise AssertionError("read before it was populated")
    except ValueError:
        pass
    view.refresh()
    o = load(spark, d, "orders")
    o.unionAll(o).createOrReplaceTempView("heddle_mv_orders")
    before = view.read().withColumnRenamed("n", "before")
    return before.join(view.refresh().withColumnRenamed("n", "after"), "state")


@query("SELECT 'f' AS name, 'SELECT 2' AS definition")
def sql_functions(spark, d):
    """Functions are kept as text: a second one of the name is refused, unless it replaces."""
    db = catalog.Database(spark)
    db.create_function("f", "SELECT 1")
    assert _refused(lambda: db.create_function("f", "SELECT 3"))
    db.create_function("f", "SELECT 2", or_replace=True)
    return db.listing().where("kind = 'function'").select("name", "definition")


@query("SELECT 'customer' AS name, 0::BIGINT AS n, 1::BIGINT AS next UNION ALL SELECT 'orders', 0, 1")
def dml_truncate(spark, d):
    """RESTRICT is refused while orders reference customers; CASCADE empties both; RESTART IDENTITY sets the sequences back."""
    db = _shop(spark, d)
    db.tables["orders"].rows = db.tables["orders"].rows.join(db.tables["customer"].rows, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    db.add_constraint("orders", "fk", catalog.Constraint("foreign", ("o_custkey",), parent="customer", parent_columns=("c_custkey",)))
    for t in db.tables.values():
        t.identity["id"] = catalog.Sequence()
        t.identity["id"].nextval()
    assert _refused(lambda: db.truncate("customer"))
    db.truncate("customer", cascade=True)
    assert all(t.identity["id"].nextval() == 2 for t in db.tables.values())  # CONTINUE IDENTITY
    db.truncate("customer", "orders", restart_identity=True)
    parts = [t.rows.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(t.identity["id"].nextval()).cast("long").alias("next")) for n, t in db.tables.items()]
    return parts[0].unionByName(parts[1])


_MOVED = "(SELECT c_custkey AS old, c_custkey + 1000000 AS new FROM customer WHERE c_nationkey = 2)"


@query(f"SELECT o_orderkey, coalesce(new, o_custkey) AS moved, CASE WHEN new IS NULL THEN o_custkey END AS nulled, CASE WHEN new IS NULL THEN o_custkey ELSE 0 END AS defaulted FROM orders LEFT JOIN {_MOVED} ON old = o_custkey")
def fk_on_update(spark, d):
    """ON UPDATE CASCADE, SET NULL and SET DEFAULT, side by side; RESTRICT is refused."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    moved = load(spark, d, "customer").where("c_nationkey = 2").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000).alias("new"))
    assert _refused(lambda: M.cascade_update(o, "o_custkey", moved, "restrict"))
    out = None
    for action, name in (("cascade", "moved"), ("set null", "nulled"), ("set default", "defaulted")):
        part = M.cascade_update(o, "o_custkey", moved, action, F.lit(0)).withColumnRenamed("o_custkey", name)
        out = part if out is None else out.join(part, "o_orderkey")
    return out


@query("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'restricted', 1")
def fk_delete_chain(spark, d):
    """A deletion that goes on from customers through orders to their lines; with RESTRICT at the end it is refused."""
    tables = {t: load(spark, d, t) for t in ("customer", "orders", "lineitem")}
    gone, pk = tables["customer"].where("c_nationkey = 3"), {"customer": "c_custkey", "orders": "o_orderkey"}
    links = [("orders", "o_custkey", "customer", "cascade"), ("lineitem", "l_orderkey", "orders", "cascade")]
    after = M.delete_chain(tables, gone, "customer", pk, links)
    refused = _refused(lambda: M.delete_chain(tables, gone, "customer", pk, [links[0], (*links[1][:3], "restrict")]))
    counts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in after.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(spark.createDataFrame([("restricted", int(refused))], "name string, n long"))


@query("SELECT c_custkey AS key, CASE WHEN c_nationkey = 1 THEN 'first: ' || upper(c_name) WHEN c_nationkey < 4 THEN c_mktsegment || ' -> ' || upper(c_name) ELSE c_mktsegment END AS value FROM customer WHERE c_nationkey <> 3")
def write_transform(spark, d):
    """A callback sees the key, the value before and the proposed one: it may rewrite the value or delete the row."""
    c = load(spark, d, "customer")
    table = c.where("c_nationkey <> 1").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), "c_nationkey")
    proposed = c.where("c_nationkey < 4").select(F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") == 3, "gone").otherwise(F.col("c_name")).alias("value"))
    callback = lambda key, old, new: F.when(new == "gone", F.lit(None)).when(old.isNull(), F.concat(F.lit("first: "), F.upper(new))).otherwise(F.concat(old, F.lit(" -> "), F.upper(new)))
    return M.transformed(table, proposed, "key", callback).where("key is not null").select("key", "value")


@query("SELECT c_custkey, 'refused' AS outcome FROM customer WHERE c_custkey < 0 UNION ALL SELECT count(*), 'refused, unchanged' FROM customer")
def rest_batch_atomic(spark, d):
    """A batch that repeats a key is a conflict, and none of it is written."""
    t = load(spark, d, "customer").select("c_custkey", "c_name")
    batch = t.select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name")
    refused = _refused(lambda: M.insert(t, batch.unionByName(batch.limit(1)), ["c_custkey"]))
    return t.agg(F.count(F.lit(1)).alias("c_custkey"), F.lit("refused, unchanged" if refused else "written").alias("outcome"))


_FIELD = """(SELECT c_custkey AS id, to_json({'email': 'u' || c_custkey || '@x', 'name': c_name}) AS doc FROM customer)"""


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 'u' || id || '@x' ELSE doc ->> 'email' END AS email, CASE WHEN id % 2 = 0 THEN 'changed' ELSE doc ->> 'name' END AS name FROM {_FIELD}")
def rest_on_conflict_field(spark, d):
    """An upsert whose conflict is on a field inside the document, not on the key: the row that has the field's value is merged."""
    k = F.col("c_custkey")
    t = load(spark, d, "customer").select(k.alias("id"), F.to_json(F.struct(F.concat(F.lit("u"), k.cast("string"), F.lit("@x")).alias("email"), F.col("c_name").alias("name"))).alias("doc"))
    new = t.where("id % 2 = 0").select(J.json_text(F.col("doc"), "email").alias("f"), F.to_json(F.struct(F.lit("changed").alias("name"))).alias("changes"))
    both = t.withColumn("e", J.json_text(F.col("doc"), "email")).join(new, F.col("e") == F.col("f"), "left")
    after = both.select("id", F.when(F.col("f").isNotNull(), M.patch(F.col("doc"), F.col("changes"))).otherwise(F.col("doc")).alias("doc"))
    return after.select("id", J.json_text(F.col("doc"), "email").alias("email"), J.json_text(F.col("doc"), "name").alias("name"))


def _branches(spark, d):
    """Roots for the regions, a child for each nation, and requests that fail."""
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    roots = B.roots(spark, n.select(F.col("r_name").alias("tenant")))
    wanted = n.select(F.col("r_name").alias("tenant"), F.col("n_name").alias("id"), F.lit("main").alias("parent"), F.col("n_nationkey").cast("long").alias("base_commit_ts"))
    return B.create(roots, wanted)[0], n


_CHILDREN = "SELECT r_name AS tenant, n_name AS id, 'main' AS parent_id, CAST(n_nationkey AS BIGINT) AS base_commit_ts, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS epoch, r_name || '/main' AS manifest_id, 0::BIGINT AS schema_version FROM nation JOIN region ON r_regionkey = n_regionkey"
_ROOTS = "SELECT DISTINCT r_name AS tenant, 'main' AS id, CAST(NULL AS VARCHAR) AS parent_id, 0::BIGINT AS base_commit_ts, 0::BIGINT AS epoch, r_name || '/main' AS manifest_id, 0::BIGINT AS schema_version FROM nation JOIN region ON r_regionkey = n_regionkey"


@query(f"{_ROOTS} UNION ALL {_CHILDREN}")
def branch_create_list(spark, d):
    return _branches(spark, d)[0]


@query("SELECT r_name AS tenant, 'x' AS id, 'no parent' AS fault FROM region UNION ALL SELECT r_name, 'y', 'nested' FROM region UNION ALL SELECT r_name, 'main', 'conflict' FROM region")
def branch_create_faults(spark, d):
    branches, n = _branches(spark, d)
    first = n.groupBy(F.col("r_name").alias("tenant")).agg(F.min("n_name").alias("child"))
    at = F.lit(1).cast("long").alias("base_commit_ts")
    requests = first.select("tenant", F.lit("x").alias("id"), F.lit("nowhere").alias("parent"), at).unionByName(first.select("tenant", F.lit("y").alias("id"), F.col("child").alias("parent"), at)).unionByName(first.select("tenant", F.lit("main").alias("id"), F.lit("main").alias("parent"), at))
    return B.create(branches, requests)[1]


@query(f"SELECT tenant, id, CASE WHEN id LIKE '%1' THEN 500 ELSE base_commit_ts END AS base_commit_ts, CASE WHEN id LIKE '%1' THEN (SELECT max(epoch) FROM ({_CHILDREN}) m WHERE m.tenant = c.tenant) + row_number() OVER (PARTITION BY tenant, id LIKE '%1' ORDER BY id) ELSE epoch END AS epoch FROM ({_CHILDREN}) c")
def branch_reset(spark, d):
    branches, _ = _branches(spark, d)
    wanted = branches.where("id like '%1'").select("tenant", "id", F.lit(500).cast("long").alias("base_commit_ts"))
    return B.reset(branches, wanted)[0].where("parent_id is not null").select("tenant", "id", "base_commit_ts", "epoch")


@query(f"SELECT 'left' AS what, tenant, id FROM ({_ROOTS} UNION ALL {_CHILDREN}) WHERE parent_id IS NULL OR base_commit_ts >= 10 UNION ALL SELECT 'has children', tenant, id FROM ({_ROOTS}) UNION ALL SELECT 'not found', r_name, 'nobody' FROM region")
def branch_delete(spark, d):
    branches, _ = _branches(spark, d)
    wanted = branches.where("parent_id is null or base_commit_ts < 10").select("tenant", "id").unionByName(load(spark, d, "region").select(F.col("r_name").alias("tenant"), F.lit("nobody").alias("id")))
    after, faults = B.delete(branches, wanted)
    return after.select(F.lit("left").alias("what"), "tenant", "id").unionByName(faults.select(F.col("fault").alias("what"), "tenant", "id"))


@query(f"SELECT tenant, max(base_commit_ts) FILTER (id = top) AS base_commit_ts, 1::BIGINT AS schema_version FROM (SELECT *, max(id) OVER (PARTITION BY tenant) AS top FROM ({_CHILDREN})) GROUP BY tenant")
def branch_promote(spark, d):
    branches, _ = _branches(spark, d)
    after, faults = B.promote(branches, branches.select("tenant", "id"))
    assert faults.count() == branches.where("parent_id is null").count()
    return after.where("parent_id is null").select("tenant", "base_commit_ts", "schema_version")


@query(f"SELECT pk, value FROM (SELECT * FROM {_V} WHERE commit_ts <= 300 QUALIFY row_number() OVER (PARTITION BY pk ORDER BY commit_ts DESC) = 1) WHERE value IS NOT NULL AND expires_at = 0")
def branch_reset_read(spark, d):
    """After a reset the branch shows its parent at the new base: what it wrote in its old epoch is gone."""
    branches = spark.createDataFrame([("t", "main", None, 0, 0, "m", 0), ("t", "b", "main", 900, 1, "m", 0)], B.BRANCHES)
    v = log(spark, d)
    own = v.where("commit_ts % 3 = 0").withColumn("value", F.lit("own")).withColumn("epoch", F.lit(1).cast("long"))
    after, _ = B.reset(branches, spark.createDataFrame([("t", "b", 300)], "tenant string, id string, base_commit_ts long"))
    branch = after.where("id = 'b'").first().asDict()
    return B.rows_of(v, own, branch, now_millis=1 << 60)


@query("SELECT event_id, json_extract_string(doc, '$.a.b[1]') AS second, CAST(json_extract(doc, '$.a.b') AS VARCHAR) AS list, json_extract_string(doc, '$.a.n') AS n FROM (SELECT event_id, '{\"a\":{\"b\":[\"x\",\"' || event_type || '\"],\"n\":' || event_id || '}}' AS doc FROM events)")
def json_chain(spark, d):
    """Chains of -> and ->> through objects and arrays."""
    doc = F.concat(F.lit('{"a":{"b":["x","'), F.col("event_type"), F.lit('"],"n":'), F.col("event_id").cast("string"), F.lit("}}"))
    e = load(spark, d, "events").select("event_id", doc.alias("doc"))
    return e.select("event_id", J.json_text(F.col("doc"), "a", "b", 1).alias("second"), J.json_value(F.col("doc"), "a", "b").alias("list"), J.json_text(F.col("doc"), "a", "n").alias("n"))


@query("SELECT c_custkey, 4 AS n, c_name || ', x' AS second, CAST(NULL AS VARCHAR) AS third, CAST(c_custkey AS VARCHAR) AS fourth FROM customer")
def array_literals(spark, d):
    """ARRAY[...] and brace literals are the same arrays."""
    c = load(spark, d, "customer")
    text = F.concat(F.lit('{a,"'), F.col("c_name"), F.lit(', x", NULL, '), F.col("c_custkey").cast("string"), F.lit("}"))
    a = c.select("c_custkey", J.brace_array(text).alias("a"), F.array(F.lit("a"), F.concat("c_name", F.lit(", x")), F.lit(None).cast("string"), F.col("c_custkey").cast("string")).alias("b"))
    return a.where(F.col("a").eqNullSafe(F.col("b"))).select("c_custkey", F.size("a").alias("n"), F.get("a", F.lit(1)).alias("second"), F.get("a", F.lit(2)).alias("third"), F.get("a", F.lit(3)).alias("fourth"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS first, greatest(c_nationkey, 7, NULL) AS most, least(c_nationkey, 7, NULL) AS least FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') IS NOT NULL AND nullif(c_nationkey, 3) IS NOT NULL")
def null_functions(spark, d):
    n = F.lit(None).cast("int")
    c = load(spark, d, "customer").where(F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).isNotNull() & F.nullif(F.col("c_nationkey"), F.lit(3)).isNotNull())
    return c.select("c_custkey", F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.col("c_name")).alias("first"), F.greatest("c_nationkey", F.lit(7), n).alias("most"), F.least("c_nationkey", F.lit(7), n).alias("least"))


@query("SELECT count(*) AS rows, count(*) AS ids, true AS formed, true AS timed FROM customer")
def generated_values(spark, d):
    """gen_random_uuid() gives each row its own, of version 4; now() is one time for the whole statement."""
    c = load(spark, d, "customer").select(F.expr("uuid()").alias("id"), F.current_timestamp().alias("at"))
    form = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return c.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.bool_and(form).alias("formed"), ((F.countDistinct("at") <= 1) & (F.max("at") <= F.now())).alias("timed"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS state, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def sql_subqueries(spark, d):
    """CASE, EXISTS, and scalar and IN subqueries, which Catalyst turns into joins."""
    for t in ("customer", "orders", "nation"):
        load(spark, d, t).createOrReplaceTempView(f"heddle_q_{t}")
    return spark.sql("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS state, (SELECT count(*) FROM heddle_q_orders WHERE o_custkey = c_custkey) AS n_orders
FROM heddle_q_customer WHERE EXISTS (SELECT 1 FROM heddle_q_orders WHERE o_custkey = c_custkey AND o_totalprice > (SELECT avg(o_totalprice) FROM heddle_q_orders)) AND c_nationkey IN (SELECT n_nationkey FROM heddle_q_nation WHERE n_regionkey <> 1)""")


_AGG = "count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 100000) AS large, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS INT) AS level"


@query(f"SELECT o_orderstatus, o_orderpriority, {_AGG} FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
def agg_grouping_sets(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("heddle_g_orders")
    return spark.sql(f"SELECT o_orderstatus, o_orderpriority, {_AGG} FROM heddle_g_orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")


def _levels(df):
    return df.agg(F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 100_000).alias("large"), F.grouping_id().cast("int").alias("level"))


@query(f"SELECT o_orderstatus, o_orderpriority, {_AGG} FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return _levels(load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority"))


@query(f"SELECT o_orderstatus, o_orderpriority, {_AGG} FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return _levels(load(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query("SELECT a.n_name AS a, b.r_name AS b FROM nation a CROSS JOIN region b WHERE a.n_regionkey < b.r_regionkey")
def join_theta(spark, d):
    """CROSS JOIN with an inequality, over two tables of a few rows each."""
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return n.crossJoin(r).where("n_regionkey < r_regionkey").select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
