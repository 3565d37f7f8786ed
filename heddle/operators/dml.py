"""Data changes as functions from the table before to the table after, with the rows they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.relational import duplicates


class ConflictError(ValueError):
    """A duplicate key or a rejected row: nothing of the statement is applied."""


def _reject(bad: DataFrame, what: str) -> None:
    if first := bad.limit(1).collect():
        raise ConflictError(f"{what}: {first[0]}")


def insert(table: DataFrame, rows: DataFrame, key: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """All rows or none: missing columns take their defaults, a known or repeated key is an error."""
    for c, value in (defaults or {}).items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), value) if c in rows.columns else value)
    _reject(duplicates(rows, key), "repeated key")
    _reject(rows.join(table.select(*key), key, "left_semi"), "key exists")
    return table.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields]))


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new keys; of rows that repeat a new key one is taken."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti").dropDuplicates(key).select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: list[str], assign: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE: new keys are inserted; for known ones `assign` sets columns.

    In `assign` and `where`, `old.c` is the table's column and `new.c` the row's. Without `assign` every
    column takes the row's value; rows that `where` doesn't accept leave the table's row as it is.
    """
    old, new = table.alias("old"), rows.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key]
    both = old.join(new, on, "full")
    known, given = F.col(f"old.{key[0]}").isNotNull(), F.col(f"new.{key[0]}").isNotNull()
    hit = known & given & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    out = []
    for c in table.columns:
        value = F.col(f"new.{c}") if assign is None else assign.get(c, F.col(f"old.{c}"))
        out.append(F.when(hit, value).when(known, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c))
    return both.select(*out)


def update_where(table: DataFrame, where: Column, assign: dict[str, Column]) -> DataFrame:
    return table.select(*[F.when(F.coalesce(where, F.lit(False)), assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns])


def update_from(table: DataFrame, source: DataFrame, on: Column, assign: dict[str, Column], key: list[str]) -> DataFrame:
    """UPDATE ... FROM: rows of `table` (alias t) that meet one of `source` (alias s) take values from it.

    If a row meets several, one of them counts: the one whose assigned values are least, so that runs agree.
    """
    met = table.alias("t").join(source.alias("s"), on).select(*[F.col(f"t.{k}").alias(k) for k in key], F.struct(*[v.alias(c) for c, v in assign.items()]).alias("__new"))
    met = met.groupBy(*key).agg(F.min("__new").alias("__new"))
    both = table.join(met, key, "left")
    return both.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, where: Column) -> DataFrame:
    """The rows that stay; an unknown condition deletes nothing."""
    return table.where(~F.coalesce(where, F.lit(False)))


def delete_using(table: DataFrame, source: DataFrame, on: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows returned)."""
    return table.alias("t").join(source.alias("s"), on, "left_anti"), table.alias("t").join(source.alias("s"), on, "left_semi")


def patch(document: Column, changes: Column) -> Column:
    """A shallow merge of two JSON objects of scalars; null in the changes sets the field to null."""
    kind = "map<string,string>"
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_zip_with(F.from_json(document, kind), F.from_json(changes, kind), lambda k, a, b: F.coalesce(b, a))))))


def cascade(child: DataFrame, fk: str, gone: DataFrame, pk: str, action: str = "cascade", default: Column | None = None) -> DataFrame:
    """Child rows after their parents `gone` are deleted: restrict, cascade, set null, set default."""
    keys = gone.select(F.col(pk).alias("__gone")).distinct()
    hit = F.col(fk) == F.col("__gone")
    if action == "cascade":
        return child.join(keys, hit, "left_anti")
    if action == "restrict":
        _reject(child.join(keys, hit, "left_semi"), "row is referenced")
        return child
    if action not in ("set null", "set default"):
        raise ValueError(action)
    value = default if action == "set default" and default is not None else F.lit(None)
    joined = child.join(keys, hit, "left")
    return joined.select(*[F.when(F.col("__gone").isNotNull(), value).otherwise(F.col(fk)).cast(child.schema[fk].dataType).alias(fk) if c == fk else F.col(c) for c in child.columns])


def cascade_update(child: DataFrame, fk: str, moved: DataFrame, action: str = "cascade", default: Column | None = None) -> DataFrame:
    """Child rows after their parents' keys change, `moved` (old, new): restrict, cascade, set null, set default. A key that stays moves no one."""
    keys = moved.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    if action == "restrict":
        _reject(child.join(keys, F.col(fk) == F.col("__old"), "left_semi"), "row is referenced")
        return child
    value = {"cascade": F.col("__new"), "set null": F.lit(None), "set default": default if default is not None else F.lit(None)}[action]
    joined = child.join(keys, F.col(fk) == F.col("__old"), "left")
    return joined.select(*[F.when(F.col("__old").isNotNull(), value).otherwise(F.col(fk)).cast(child.schema[fk].dataType).alias(fk) if c == fk else F.col(c) for c in child.columns])


def delete_chain(tables: dict[str, DataFrame], gone: DataFrame, name: str, pk: dict[str, str], links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """All tables after rows `gone` of table `name` are deleted; `links` (child, foreign key, parent, action) are followed as long as cascades delete rows.

    The links, not the rows, are walked on the driver: a plan for each. Links may not form a circle of cascades.
    """
    after, todo = dict(tables), [(name, gone, ())]
    after[name] = after[name].join(gone.select(pk[name]).distinct(), pk[name], "left_anti")
    while todo:
        parent, lost, path = todo.pop()
        for child, fk, of, action in links:
            if of != parent:
                continue
            if child in path:
                raise ValueError(f"cascades go in a circle at {child}")
            before = after[child]
            after[child] = cascade(before, fk, lost, pk[parent], action)
            if action == "cascade":
                todo.append((child, before.join(lost.select(F.col(pk[parent]).alias("__gone")).distinct(), F.col(fk) == F.col("__gone"), "left_semi"), (*path, parent)))
    return after


def transformed(table: DataFrame, proposed: DataFrame, key: str, transform: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Writes (key, value) pass a callback before they are stored: `transform`(key, value before or null, proposed value) gives the value; null deletes the row."""
    before, new = table.select(F.col(key).alias("__b"), F.col("value").alias("__old")), proposed.select(F.col(key).alias("__p"), F.col("value").alias("__new"))
    both = before.join(new, F.col("__b") == F.col("__p"), "full")
    value = F.when(F.col("__p").isNotNull(), transform(F.col("__p"), F.col("__old"), F.col("__new"))).otherwise(F.col("__old"))
    return both.select(F.coalesce("__b", "__p").alias(key), value.alias("value")).where("value is not null")


def rename_columns(columns: list[str], renamed: dict[str, str]) -> list[str]:
    return [renamed.get(c, c) for c in columns]


def alter(table: DataFrame, add: dict[str, Column] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, types: dict[str, str] | None = None, not_null: list[str] | None = None) -> DataFrame:
    """ALTER TABLE: columns added with their defaults in all rows, dropped, renamed, converted; NOT NULL is checked on the rows there are."""
    for c, value in (add or {}).items():
        table = table.withColumn(c, value)
    table = table.drop(*(drop or [])).withColumnsRenamed(rename or {})
    for c, kind in (types or {}).items():
        table = table.withColumn(c, F.col(c).cast(kind))
    for c in not_null or []:
        _reject(table.where(F.col(c).isNull()), f"{c} is null")
    return table


def stamped(table: DataFrame, column: str, when: Column | None = None) -> DataFrame:
    """A BEFORE trigger that stamps rows with the time."""
    return table.withColumn(column, F.current_timestamp() if when is None else when)
