"""Versioned reads over a log made of the events: key user, commit event_id + 1, every seventh a deletion, some expiring."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import cdc as C
from heddle.operators import relational as R
from heddle.operators import versions as V
from heddle.plans.base import query
from heddle.session import load


def log(spark, d):
    e = F.col("event_id")
    return load(spark, d, "events").select(F.col("user_id").alias("pk"), (e + 1).alias("commit_ts"), F.when(e % 7 != 0, F.concat_ws(":", "event_type", e.cast("string"))).alias("value"), F.when(e % 5 == 0, e).otherwise(0).alias("expires_at"))


_V = "(SELECT user_id AS pk, event_id + 1 AS commit_ts, CASE WHEN event_id % 7 <> 0 THEN event_type || ':' || event_id END AS value, CASE WHEN event_id % 5 = 0 THEN event_id ELSE 0 END AS expires_at FROM events)"
_NEWEST = f"(SELECT * FROM {_V} WHERE commit_ts <= {{at}} QUALIFY row_number() OVER (PARTITION BY pk ORDER BY commit_ts DESC) = 1)"
_LIVE = "value IS NOT NULL AND NOT (expires_at <> 0 AND expires_at * 1000 <= {now})"


def _at(at, now=400_000):
    return f"SELECT * FROM {_NEWEST.format(at=at)} WHERE {_LIVE.format(now=now)}"


@query(_at(700))
def version_snapshot(spark, d):
    return V.snapshot(log(spark, d), at=700, now_millis=400_000)


@query(_at(1 << 40, 0))
def version_latest(spark, d):
    return V.snapshot(log(spark, d), now_millis=0)


@query(f"SELECT * FROM {_NEWEST.format(at=500)}")
def version_as_of(spark, d):
    return V.newest(log(spark, d), at=500)


@query(f"SELECT pk, commit_ts FROM (SELECT *, lag(commit_ts) OVER (PARTITION BY pk ORDER BY (commit_ts * 37) % 1009, commit_ts) AS b FROM {_V}) WHERE commit_ts <= b")
def version_out_of_order(spark, d):
    scrambled = log(spark, d).withColumn("lsn", F.struct((F.col("commit_ts") * 37) % 1009, F.col("commit_ts")))
    return V.out_of_order(scrambled).select("pk", "commit_ts")


@query(f"SELECT v.* FROM {_V} v LEFT JOIN (SELECT pk, max(commit_ts) AS m FROM {_V} WHERE commit_ts <= 600 GROUP BY pk) l ON l.pk = v.pk WHERE commit_ts > 600 OR commit_ts = m")
def version_gc(spark, d):
    return V.collect_garbage(log(spark, d), 600)


@query(f"SELECT pk, commit_ts, CASE WHEN commit_ts % 3 = 0 THEN 'patched' ELSE value END AS value, expires_at FROM {_V}")
def version_compact(spark, d):
    v = log(spark, d)
    return V.compact(v, v.where("commit_ts % 3 = 0").withColumn("value", F.lit("patched")))




@query(f"""SELECT coalesce(o.pk, b.pk) AS pk, CASE WHEN o.pk IS NOT NULL THEN o.v ELSE b.value END AS value
FROM ({_at(250, 0)}) b FULL JOIN (SELECT pk, CASE WHEN max(commit_ts) % 4 = 0 THEN NULL ELSE 'own' || max(commit_ts) END AS v FROM {_V} WHERE commit_ts BETWEEN 300 AND 400 GROUP BY pk) o ON o.pk = b.pk
WHERE CASE WHEN o.pk IS NOT NULL THEN o.v ELSE b.value END IS NOT NULL""")
def branch_overlay(spark, d):
    v = log(spark, d)
    own = v.where("commit_ts between 300 and 400").withColumn("value", F.when(F.col("commit_ts") % 4 != 0, F.concat(F.lit("own"), F.col("commit_ts").cast("string")))).withColumn("expires_at", F.lit(0).cast("long"))
    return V.branch_read(v, own, 250)


@query("SELECT 'only_left' AS side, n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'only_right', n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 4")
def branch_diff(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return V.branch_diff(n.where("n_regionkey <> 4"), n.where("n_regionkey <> 0"))


@query("SELECT 300::BIGINT AS commit_ts, 'c' AS id")
def pitr_checkpoint(spark, d):
    return V.pick_checkpoint(spark.createDataFrame([(100, "a"), (300, "c"), (200, "b"), (900, "d")], "commit_ts long, id string"), 450)


@query(f"SELECT * FROM {_V} WHERE commit_ts <= 450")
def pitr_restore(spark, d):
    return V.restore(log(spark, d), 450)


@query(f"SELECT a.pk, a.commit_ts AS tx_id, b.commit_ts AS other_ts FROM {_V} a JOIN {_V} b ON a.pk = b.pk AND b.commit_ts > a.commit_ts - 60 AND b.commit_ts < a.commit_ts")
def conflict_audit(spark, d):
    v = log(spark, d)
    writes = v.select(F.col("commit_ts").alias("tx_id"), "pk", (F.col("commit_ts") - 60).alias("read_ts"), "commit_ts")
    return V.write_conflicts(writes, v).select("pk", "tx_id", "other_ts")


@query("SELECT c_custkey AS pk, CASE WHEN c_custkey % 10 = 3 THEN 'staged' ELSE c_name END AS value FROM customer WHERE c_custkey % 10 <> 7 ORDER BY c_custkey LIMIT 50")
def txn_read_own_writes(spark, d):
    base = load(spark, d, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("value"))
    staged = base.where("pk % 10 in (3, 7)").select("pk", F.lit("staged").alias("value"), (F.col("pk") % 10 == 7).alias("deleted"))
    return R.overlay(base, staged, "pk").orderBy("pk").limit(50)


@query("SELECT n_name AS id FROM nation WHERE n_nationkey = 7 UNION ALL SELECT n_name FROM nation WHERE n_nationkey IN (15, 16)")
def ledger_verify(spark, d):
    """A ledger of a migration for each nation: one whose text was changed later, one that is missing (the next has no parent), one that follows another parent."""
    from heddle.functions.hashes import fnv1a64_int

    rows, parent = [], ""
    names = [r.n_name for r in load(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]  # 25 rows
    for i, name in enumerate(names, 1):
        checksum = f"{fnv1a64_int((parent + name + f'CREATE TABLE t{i}').encode()):016x}"
        rows.append((i, name, f"CREATE TABLE t{i}", parent, checksum))
        parent = checksum
    rows[7] = (*rows[7][:2], "DROP TABLE t8", *rows[7][3:])
    rows[16] = (17, rows[16][1], "x", "0", f"{fnv1a64_int(('0' + rows[16][1] + 'x').encode()):016x}")
    rows[17] = (18, rows[17][1], rows[17][2], rows[16][4], f"{fnv1a64_int((rows[16][4] + rows[17][1] + rows[17][2]).encode()):016x}")
    for i in range(18, len(rows)):
        rows[i] = (*rows[i][:3], rows[i - 1][4], f"{fnv1a64_int((rows[i - 1][4] + rows[i][1] + rows[i][2]).encode()):016x}")
    del rows[14]
    return V.ledger_breaks(spark.createDataFrame(rows, "version long, id string, sql string, parent_checksum string, checksum string")).select("id")


@query("""SELECT CASE WHEN c_custkey % 10 = 1 THEN 'INSERT' WHEN c_custkey % 10 = 2 THEN 'DELETE' ELSE 'UPDATE' END AS op, c_custkey AS pk,
 CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE c_name END AS before, CASE WHEN c_custkey % 10 = 2 THEN NULL WHEN c_custkey % 10 = 3 THEN upper(c_name) ELSE c_name END AS after
 FROM customer WHERE c_custkey % 10 IN (1, 2) OR (c_custkey % 10 = 3 AND upper(c_name) <> c_name)""")
def cdc_diff(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey") % 10
    out = C.changes(c.where(k != 1), c.where(k != 2).withColumn("c_name", F.when(k == 3, F.upper("c_name")).otherwise(F.col("c_name"))), "c_custkey")
    return out.select("op", "pk", F.col("before.c_name").alias("before"), F.col("after.c_name").alias("after"))


def records(spark, d):
    """Change records: eight events a commit, topic by event type."""
    e = F.col("event_id")
    r = load(spark, d, "events").select(F.col("event_type").alias("topic"), F.when(e % 9 == 0, "DELETE").otherwise("UPDATE").alias("op"), F.col("user_id").alias("pk"), F.when(e % 9 != 0, F.concat(F.lit("v"), e.cast("string"))).alias("after"), F.floor(e / 8).alias("commit_ts"), "event_id")
    return C.sequenced(r, ["topic"], ["event_id"])


_R = "(SELECT event_type AS topic, CASE WHEN event_id % 9 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS op, user_id AS pk, CASE WHEN event_id % 9 <> 0 THEN 'v' || event_id END AS after, event_id // 8 AS commit_ts, (event_id // 8) * 1000000 + row_number() OVER (PARTITION BY event_type, event_id // 8 ORDER BY event_id) AS sequence, event_id FROM events)"


@query(f"SELECT topic, event_id, sequence FROM {_R}")
def cdc_sequence(spark, d):
    return records(spark, d).select("topic", "event_id", "sequence")


@query(f"SELECT topic, event_id, commit_ts FROM {_R} WHERE commit_ts > 40 AND topic = 'view' ORDER BY commit_ts, sequence LIMIT 50")
def cdc_replay_commit(spark, d):
    return C.replay(records(spark, d).where("topic = 'view'"), 40, 50).select("topic", "event_id", "commit_ts")


@query(f"SELECT topic, event_id FROM {_R} WHERE sequence > 55000001 AND topic = 'click' ORDER BY sequence LIMIT 50")
def cdc_replay_sequence(spark, d):
    return C.replay(records(spark, d).where("topic = 'click'"), 55_000_001, 50, "sequence").select("topic", "event_id")


@query(f"SELECT topic, min(sequence) AS front, max(sequence) AS back FROM {_R} GROUP BY topic")
def cdc_bounds(spark, d):
    return records(spark, d).groupBy("topic").agg(F.min("sequence").alias("front"), F.max("sequence").alias("back"))


@query(f"SELECT topic, event_id FROM {_R} QUALIFY row_number() OVER (PARTITION BY topic ORDER BY sequence DESC) <= 64")
def cdc_evict(spark, d):
    return C.keep_last(records(spark, d), ["topic"], "sequence", 64).select("topic", "event_id")


@query(f"SELECT topic, event_id FROM {_R} WHERE sequence > 20000000")
def cdc_resume_once(spark, d):
    """Two overlapping reads deliver a record once."""
    r = records(spark, d).where("sequence > 20000000")
    return r.unionByName(r.where("sequence < 60000000")).dropDuplicates(["topic", "sequence"]).select("topic", "event_id")


@query(f"SELECT pk, after FROM (SELECT * FROM {_R} WHERE topic = 'purchase' QUALIFY row_number() OVER (PARTITION BY pk ORDER BY sequence DESC) = 1) WHERE op <> 'DELETE'")
def cdc_fold(spark, d):
    return C.fold(records(spark, d).where("topic = 'purchase'")).select("pk", "after")


@query("SELECT user_id % 4 AS partition, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS cursor FROM events")
def topic_append(spark, d):
    return C.appended(load(spark, d, "events").select((F.col("user_id") % 4).alias("partition"), "event_id"), "event_id")


@query("SELECT partition, event_id FROM (SELECT user_id % 4 AS partition, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) AS n FROM events) WHERE n <= 100")
def topic_retention(spark, d):
    t = C.appended(load(spark, d, "events").select((F.col("user_id") % 4).alias("partition"), "event_id"), "event_id")
    return C.retained(t, 100).select("partition", "event_id")


@query("SELECT partition, cursor, event_id FROM (SELECT user_id % 4 AS partition, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS cursor FROM events) WHERE partition = 2 AND cursor >= 30 ORDER BY cursor LIMIT 40")
def topic_read(spark, d):
    t = C.appended(load(spark, d, "events").select((F.col("user_id") % 4).alias("partition"), "event_id"), "event_id")
    return t.where("partition = 2 and cursor >= 30").orderBy("cursor").limit(40).select("partition", "cursor", "event_id")


@query("SELECT * FROM (VALUES (0, 1, 'other', 'conflict'), (0, 5, 'e', 'gap'), (1, 1, 'y', 'gap')) t(partition, cursor, value, fault)")
def topic_faults(spark, d):
    topic = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c")], "partition int, cursor int, value string")
    batch = spark.createDataFrame([(0, 1, "other"), (0, 2, "c"), (0, 3, "d"), (0, 5, "e"), (1, 1, "y")], "partition int, cursor int, value string")
    return C.append_faults(topic, batch)


@query("""SELECT room, member, t + 3600 AS expires_unix FROM (SELECT event_type AS room, user_id AS member, floor(epoch(ts))::BIGINT AS t, CASE WHEN event_id % 4 = 0 THEN 'leave' ELSE 'join' END AS kind FROM events
 WHERE floor(epoch(ts))::BIGINT <= 1705000000 QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE kind = 'join' AND t + 3600 > 1705000000""")
def presence_members(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("room"), F.col("user_id").alias("member"), F.unix_timestamp("ts").alias("at"), F.when(F.col("event_id") % 4 == 0, "leave").otherwise("join").alias("kind"))
    return C.present(e, 1_705_000_000, 3600)


@query("SELECT 'DELETE' AS op, CAST(c_custkey AS VARCHAR) AS key, c_name AS before, CAST(NULL AS VARCHAR) AS after FROM customer WHERE c_custkey % 3 = 1 AND c_custkey <= 90")
def expiry_sweep(spark, d):
    k = F.col("c_custkey")
    t = load(spark, d, "customer").select(k.cast("string").alias("key"), F.col("c_name").alias("value"), F.when(k % 3 == 1, k).otherwise(0).alias("expires_at"))
    return C.expiry_deletes(t, 90_500)
