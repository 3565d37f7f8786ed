"""Branches as rows (tenant, id, parent_id, base_commit_ts, epoch, manifest_id, schema_version), changed by tables of requests.

A request that can't be met is a fault; the others are done. Epochs are never given twice in a tenant,
and a branch's own rows carry the epoch in which they were written, so that a reset hides them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators import versions

BRANCHES = "tenant string, id string, parent_id string, base_commit_ts long, epoch long, manifest_id string, schema_version long"


def roots(spark: SparkSession, tenants: DataFrame, root: str = "main") -> DataFrame:
    """A root branch for each of `tenants` (tenant), in epoch 0."""
    rows = tenants.select("tenant").distinct()
    return rows.select("tenant", F.lit(root).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("base_commit_ts"), F.lit(0).cast("long").alias("epoch"), F.concat_ws("/", "tenant", F.lit(root)).alias("manifest_id"), F.lit(0).cast("long").alias("schema_version"))


def _with_epochs(branches: DataFrame, requests: DataFrame) -> DataFrame:
    """`requests` with the tenant's next epochs, in order of id."""
    top = branches.groupBy("tenant").agg(F.max("epoch").alias("top"))
    place = F.row_number().over(Window.partitionBy("tenant").orderBy("id"))
    return requests.withColumn("place", place).join(top, "tenant").withColumn("epoch", F.col("top") + F.col("place")).drop("top", "place")


def create(branches: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children (tenant, id, parent, base_commit_ts): (branches after, faults).

    Faults: "conflict" (the id is there, or asked for twice), "no parent", "nested" (the parent is a child itself).
    """
    asked = requests.groupBy("tenant", "id").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("parent", "base_commit_ts")).alias("r")).select("tenant", "id", "r.*", "times")
    known = branches.select("tenant", "id", F.lit(True).alias("known"))
    parents = branches.select("tenant", F.col("id").alias("parent"), F.col("parent_id").alias("grand"), "manifest_id", "schema_version")
    told = asked.join(known, ["tenant", "id"], "left").join(parents, ["tenant", "parent"], "left")
    fault = F.when(F.col("known") | (F.col("times") > 1), "conflict").when(F.col("manifest_id").isNull(), "no parent").when(F.col("grand").isNotNull(), "nested")
    told = told.withColumn("fault", fault)
    made = _with_epochs(branches, told.where("fault is null"))
    made = made.select("tenant", "id", F.col("parent").alias("parent_id"), "base_commit_ts", "epoch", "manifest_id", "schema_version")
    return branches.unionByName(made), told.where("fault is not null").select("tenant", "id", "fault")


def reset(branches: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Branches (tenant, id, base_commit_ts) start anew at a commit: a new epoch, so none of their own rows."""
    r = _with_epochs(branches, requests.join(branches.select("tenant", "id"), ["tenant", "id"], "left_semi").dropDuplicates(["tenant", "id"]))
    r = r.select("tenant", "id", F.col("base_commit_ts").alias("new_base"), F.col("epoch").alias("new_epoch"))
    after = branches.join(r, ["tenant", "id"], "left").withColumn("base_commit_ts", F.coalesce("new_base", "base_commit_ts")).withColumn("epoch", F.coalesce("new_epoch", "epoch"))
    faults = requests.join(branches.select("tenant", "id"), ["tenant", "id"], "left_anti").select("tenant", "id", F.lit("not found").alias("fault"))
    return after.select(*branches.columns), faults


def delete(branches: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Branches (tenant, id) go, but not those that have children."""
    children = branches.where("parent_id is not null").select("tenant", F.col("parent_id").alias("id")).distinct()
    gone = requests.select("tenant", "id").distinct()
    free = gone.join(children, ["tenant", "id"], "left_anti").join(branches.select("tenant", "id"), ["tenant", "id"], "left_semi")
    held = gone.join(children, ["tenant", "id"], "left_semi").select("tenant", "id", F.lit("has children").alias("fault"))
    missing = gone.join(branches.select("tenant", "id"), ["tenant", "id"], "left_anti").select("tenant", "id", F.lit("not found").alias("fault"))
    return branches.join(free, ["tenant", "id"], "left_anti"), held.unionByName(missing)


def promote(branches: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents take the manifest and the base of their children (tenant, id), and a new schema version; of several children of one parent the last id counts."""
    asked = branches.join(requests.select("tenant", "id").distinct(), ["tenant", "id"], "left_semi")
    child = asked.where("parent_id is not null").groupBy("tenant", "parent_id").agg(F.max_by(F.struct("manifest_id", "base_commit_ts", "schema_version"), "id").alias("c"))
    child = child.select("tenant", F.col("parent_id").alias("id"), F.col("c.manifest_id").alias("m"), F.col("c.base_commit_ts").alias("b"), F.col("c.schema_version").alias("v"))
    after = branches.join(child, ["tenant", "id"], "left")
    after = after.withColumn("schema_version", F.when(F.col("m").isNotNull(), F.greatest("schema_version", "v") + 1).otherwise(F.col("schema_version"))).withColumn("manifest_id", F.coalesce("m", "manifest_id")).withColumn("base_commit_ts", F.coalesce("b", "base_commit_ts"))
    faults = asked.where("parent_id is null").select("tenant", "id", F.lit("root").alias("fault"))
    missing = requests.select("tenant", "id").distinct().join(branches.select("tenant", "id"), ["tenant", "id"], "left_anti").select("tenant", "id", F.lit("not found").alias("fault"))
    return after.select(*branches.columns), faults.unionByName(missing)


def rows_of(log: DataFrame, own: DataFrame, branch: dict, key: str = "pk", now_millis: int = 0) -> DataFrame:
    """A branch's rows: the parent's as of its base under its own (epoch and a version log) of its epoch."""
    return versions.branch_read(log, own.where(F.col("epoch") == branch["epoch"]).drop("epoch"), branch["base_commit_ts"], key, now_millis)
