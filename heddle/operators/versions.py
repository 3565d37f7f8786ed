"""Reads of versioned rows: as of a commit, through branches, after collection; audits of commits.

A version log has a key, `commit_ts` (1 and up), a `value` (null: deleted) and `expires_at`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.expiry import expired


def newest(log: DataFrame, key: str = "pk", at: int | None = None) -> DataFrame:
    """The newest version of each key, up to commit `at`: a maximum by key, pre-aggregated, instead of an ordered window."""
    rows = log if at is None else log.where(F.col("commit_ts") <= at)
    rest = [c for c in log.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "commit_ts").alias("__v")).select(key, "__v.*").select(*log.columns)


def snapshot(log: DataFrame, key: str = "pk", at: int | None = None, now_millis: int = 0) -> DataFrame:
    """Rows visible at a commit: the newest version first, then deleted and expired ones are hidden, so that none falls back."""
    return newest(log, key, at).where(F.col("value").isNotNull() & ~expired(F.col("expires_at"), now_millis))


def out_of_order(log: DataFrame, key: str = "pk") -> DataFrame:
    """Versions, in log order `lsn`, whose commit isn't above the key's one before, or is below 1."""
    before = F.lag("commit_ts").over(Window.partitionBy(key).orderBy("lsn"))
    return log.withColumn("before_ts", before).where((F.col("commit_ts") < 1) | (F.col("commit_ts") <= F.col("before_ts")))


def collect_garbage(log: DataFrame, retain_ts: int, key: str = "pk") -> DataFrame:
    """For each key the newest version up to `retain_ts` and all that are newer."""
    last = log.where(F.col("commit_ts") <= retain_ts).groupBy(key).agg(F.max("commit_ts").alias("__last"))
    return log.join(last, key, "left").where((F.col("commit_ts") > retain_ts) | (F.col("commit_ts") == F.col("__last"))).drop("__last")


def compact(*deltas: DataFrame, key: str = "pk") -> DataFrame:
    """One version log of several: equal (key, commit) pairs of later logs win."""
    rows = None
    for i, d in enumerate(deltas):
        d = d.withColumn("__i", F.lit(i))
        rows = d if rows is None else rows.unionByName(d)
    rest = [c for c in deltas[0].columns if c not in (key, "commit_ts")]
    return rows.groupBy(key, "commit_ts").agg(F.max_by(F.struct(*rest), "__i").alias("__v")).select(key, "commit_ts", "__v.*").select(*deltas[0].columns)


def branch_read(parent: DataFrame, overlay: DataFrame, base_commit_ts: int, key: str = "pk", now_millis: int = 0) -> DataFrame:
    """A branch: the parent as of the branch's base, under the branch's own newest rows; a deletion hides the parent's row."""
    base = snapshot(parent, key, base_commit_ts, now_millis).select(key, "value")
    own = newest(overlay, key).select(F.col(key).alias("__k"), F.when(~expired(F.col("expires_at"), now_millis), F.col("value")).alias("__v"))
    both = base.join(own, F.col(key) == F.col("__k"), "full")
    return both.select(F.coalesce("__k", key).alias(key), F.when(F.col("__k").isNotNull(), F.col("__v")).otherwise(F.col("value")).alias("value")).where("value is not null")


def branch_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only: (side, columns)."""
    l, r = left.exceptAll(right), right.exceptAll(left)
    return l.select(F.lit("only_left").alias("side"), "*").unionByName(r.select(F.lit("only_right").alias("side"), "*"))


def pick_checkpoint(checkpoints: DataFrame, target: int) -> DataFrame:
    """The newest checkpoint at or before the target commit."""
    return checkpoints.where(F.col("commit_ts") <= target).orderBy(F.desc("commit_ts")).limit(1)


def restore(log: DataFrame, target: int) -> DataFrame:
    """The log at the target: what came later is discarded."""
    return log.where(F.col("commit_ts") <= target)


def write_conflicts(writes: DataFrame, commits: DataFrame, key: str = "pk") -> DataFrame:
    """Transactions' writes (tx_id, key, read_ts, commit_ts) that a commit strictly between their two times touched."""
    c = commits.select(F.col(key).alias("__k"), F.col("commit_ts").alias("other_ts"))
    return writes.join(c, (F.col(key) == F.col("__k")) & (F.col("other_ts") > F.col("read_ts")) & (F.col("other_ts") < F.col("commit_ts"))).drop("__k")


def ledger_breaks(ledger: DataFrame) -> DataFrame:
    """Entries of a hash-chained migration ledger (version, id, sql, parent_checksum, checksum) that break it.

    Each entry meets the one of the version before it in a join, so that versions must be dense from 1;
    ids and versions must be unique.
    """
    from heddle.functions.hashes import fnv1a64

    before = ledger.select((F.col("version") + 1).alias("__v"), F.col("checksum").alias("__c"))
    told = ledger.join(before, F.col("version") == F.col("__v"), "left").withColumn("__want", fnv1a64(F.concat("parent_checksum", "id", "sql")))
    first = F.col("version") == 1
    broken = F.when(first, F.col("parent_checksum") != "").otherwise(~F.col("parent_checksum").eqNullSafe(F.col("__c"))) | (F.col("checksum") != F.col("__want")) | (F.col("version") < 1)
    repeated = ledger.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("id").alias("__id"))
    told = told.join(repeated, F.col("id") == F.col("__id"), "left")
    return told.where(broken | F.col("__id").isNotNull()).select(*ledger.columns).distinct()
