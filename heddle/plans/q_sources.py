"""COPY text, dumps, logs and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import versions as V
from heddle.plans.base import query
from heddle.plans.q_versions import log
from heddle.session import load, remove
from heddle.session import scratch as _folder
from heddle.sources import copytext, logs, readers


_ROW = r"c_custkey || chr(9) || CASE WHEN c_custkey % 5 = 0 THEN '\N' ELSE 'a\\b\tc\nd' || c_name END || chr(9) || c_nationkey"


def _rows(spark, d):
    body = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("a\\b\tc\nd"), "c_name"))
    return load(spark, d, "customer").select("c_custkey", body.alias("body"), "c_nationkey")


@query(f"SELECT {_ROW} AS value FROM customer")
def copy_to(spark, d):
    return copytext.to_copy(_rows(spark, d))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'a' || chr(92) || 'b' || chr(9) || 'c' || chr(10) || 'd' || c_name END AS body, c_nationkey FROM customer")
def copy_round_trip(spark, d):
    path = _folder(spark)
    copytext.write_copy(_rows(spark, d), path)
    return copytext.read_copy(spark, path, "c_custkey long, body string, c_nationkey int")


@query("SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE '' END AS value FROM customer")
def copy_kv(spark, d):
    value = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).otherwise("\\N")
    return copytext.parse_copy_kv(load(spark, d, "customer").select(F.concat_ws("\t", F.concat(F.lit("k"), F.col("c_custkey").cast("string")), value).alias("value")))


@query(r"SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '\x' || chr(9) || c_name END AS value, false AS oversized FROM customer UNION ALL SELECT '', 'v', true")
def dump_copy(spark, d):
    k = F.concat(F.lit(" k"), F.col("c_custkey").cast("string"))
    lines = load(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, k).otherwise(F.concat(k, F.lit("\t\\x\\t"), "c_name")).alias("value"))
    return copytext.import_dump(lines.unionByName(spark.createDataFrame([("",), ("\\.",), ("\tv",)], "value string")))


@query("SELECT count(*) AS rows, sum(strlen(CAST(doc_id AS VARCHAR)) + strlen(text))::BIGINT AS bytes, 0::BIGINT AS oversized FROM documents")
def dump_report(spark, d):
    return copytext.report(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value")))


@query("SELECT 'users' AS table, 'it''s ' || c_custkey AS key, c_name AS value FROM customer")
def dump_inserts(spark, d):
    line = F.concat(F.lit("insert into \"users\" (a, b) values ('it''s "), F.col("c_custkey").cast("string"), F.lit("', '"), "c_name", F.lit("', 5);"))
    return copytext.parse_inserts(load(spark, d, "customer").select(line.alias("value")).unionByName(spark.createDataFrame([("-- INSERT",), ("INSERT INTO t VALUES ('one')",)], "value string")))


@query("SELECT * FROM (VALUES ('table', 'public.people', 'public.people', ''), ('policy', 'own rows', 'people', '(auth.uid() = owner)')) t(kind, name, \"table\", expression)")
def dump_objects(spark, d):
    lines = ["CREATE TABLE IF NOT EXISTS public.people (id uuid);", 'CREATE POLICY "own rows" ON people FOR SELECT USING ((auth.uid() = owner));', "SELECT 1;"]
    return copytext.dump_objects(spark.createDataFrame([(x,) for x in lines], "value string"))


@query("SELECT c_custkey, (c_custkey << 32) + c_custkey * 255 AS position FROM customer")
def dump_lsn(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select("c_custkey", copytext.lsn(F.concat_ws("/", F.hex(k), F.hex(k * 255))).alias("position"))


@query("SELECT user_id AS pk, event_id + 1 AS commit_ts FROM events WHERE CAST(user_id AS VARCHAR) >= '2' AND CAST(user_id AS VARCHAR) < '5'")
def history_range(spark, d):
    path = _folder(spark)
    logs.export_history(log(spark, d).withColumn("pk", F.col("pk").cast("string")), path, "2", "5")
    return logs.import_history(spark, path).select(F.col("pk").cast("long").alias("pk"), "commit_ts")


@query("SELECT CAST(user_id AS VARCHAR) AS pk, max(event_id + 1) AS commit_ts FROM events GROUP BY 1")
def segment_merge(spark, d):
    """A snapshot and two deltas, merged to the newest version of each key; a superseded segment is left out."""
    path, v = _folder(spark), log(spark, d).withColumn("pk", F.col("pk").cast("string"))
    logs.write_segment(v.where("commit_ts < 200"), path, 1, "delta")
    logs.write_segment(v.where("commit_ts < 500"), path, 2, "snapshot")
    logs.write_segment(v.where("commit_ts >= 500 and commit_ts < 800"), path, 3, "delta")
    logs.write_segment(v.where("commit_ts >= 800"), path, 4, "delta")
    rows = logs.read_segments(spark, path)
    live = logs.live_segments(rows.select("segment_id", "kind").distinct())
    rows = rows.join(live.select("segment_id"), "segment_id", "left_semi").select("pk", "commit_ts", "value", "expires_at")
    return V.newest(rows.repartition(logs.parts(rows), "pk")).select("pk", "commit_ts")  # whole versions are ordered to be merged


@query("SELECT event_id AS lsn, event_id // 8 AS commit_ts, event_type AS payload FROM events WHERE event_id > 300")
def wal_truncate(spark, d):
    path = _folder(spark)
    rows = load(spark, d, "events").select(F.col("event_id").alias("lsn"), F.floor(F.col("event_id") / 8).alias("commit_ts"), F.col("event_type").alias("payload"))
    logs.append_wal(rows.where("lsn <= 500"), f"{path}/a")
    logs.append_wal(rows.where("lsn > 500"), f"{path}/a")
    logs.truncate_wal(spark, f"{path}/a", f"{path}/b", 200)
    return logs.read_wal(spark, f"{path}/b", 300)


@query("SELECT 1::BIGINT AS damaged, count(*) AS rows FROM orders WHERE o_orderstatus = 'P'")
def archive_check(spark, d):
    """Of an archive with an object for each state, the one whose rows were changed is found, with the rows that it had."""
    path = _folder(spark)
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    logs.archive(orders.repartition("o_orderstatus"), path, by="o_orderstatus")
    assert logs.damaged(spark, path).isEmpty()
    remove(spark, f"{path}/objects/o_orderstatus=P")
    orders.where("o_orderstatus = 'P' and o_orderkey > 10").select("o_orderkey").coalesce(1).write.parquet(f"{path}/objects/o_orderstatus=P")
    return logs.damaged(spark, path).agg(F.countDistinct("file").alias("damaged"), F.sum("rows").alias("rows"))


@query("SELECT c_custkey AS pk, c_name, c_acctbal FROM customer")
def snapshot_round_trip(spark, d):
    """A whole state of several tables, written as one snapshot and read back."""
    path = _folder(spark)
    logs.write_snapshot({"customer": load(spark, d, "customer"), "nation": load(spark, d, "nation")}, path)
    tables = logs.read_snapshot(spark, path)
    assert sorted(tables) == ["customer", "nation"] and tables["nation"].count() == load(spark, d, "nation").count()
    return tables["customer"].select(F.col("c_custkey").alias("pk"), "c_name", "c_acctbal")


@query("SELECT * FROM (VALUES (4::BIGINT, 'snapshot'), (5, 'delta'), (6, 'delta')) t(segment_id, kind)")
def segment_prune(spark, d):
    """Segments that the newest snapshot supersedes are removed from the store."""
    path, v = _folder(spark), log(spark, d).withColumn("pk", F.col("pk").cast("string"))
    for i, kind in enumerate(("delta", "snapshot", "delta", "snapshot", "delta", "delta"), 1):
        logs.write_segment(v.where(F.col("commit_ts") % 6 == i - 1), path, i, kind)
    assert logs.prune(spark, path) == 3
    return logs.read_segments(spark, path).select("segment_id", "kind").distinct()


_JSON_ROWS = "(SELECT 'k' || c_custkey AS key, c_name AS value FROM customer)"


@query(f"SELECT 'docs' AS \"table\", key, value FROM {_JSON_ROWS}")
def ingest_json(spark, d):
    """Bulk JSON bodies {table, rows: [{key, value}]}, one a line; a body without a table, or a row without a key, is refused."""
    c = load(spark, d, "customer").select(F.struct(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value")).alias("r"), F.floor(F.col("c_custkey") / 100).alias("body"))
    bodies = c.groupBy("body").agg(F.to_json(F.struct(F.lit("docs").alias("table"), F.collect_list("r").alias("rows"))).alias("value")).select("value")
    return readers.ingest_json(bodies)


@query("SELECT format, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('parquet'), ('orc'), ('csv'), ('json'), ('arrow'), ('jdbc')) f(format) WHERE o_orderstatus = 'O' GROUP BY format")
def source_formats(spark, d):
    """The same rows through Parquet, ORC, CSV, JSON, Arrow IPC files and JDBC, with the filter on the reader's side."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = None
    for kind in ("parquet", "orc", "csv", "json", "arrow", "jdbc"):
        back = readers.round_trip(orders, kind, _folder(spark)).where("o_orderstatus = 'O'")
        part = back.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(kind).alias("format"), "*")
        out = part if out is None else out.unionByName(part)
    return out
