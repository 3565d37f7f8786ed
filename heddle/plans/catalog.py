"""Tables, views, materialised views and sequences of a session."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: SQL type names to Spark's.
TYPES = {"bool": "boolean", "boolean": "boolean", "int2": "smallint", "smallint": "smallint", "int4": "int", "integer": "int", "int8": "bigint", "bigint": "bigint", "serial": "bigint", "float4": "float", "real": "float", "float8": "double", "double precision": "double", "numeric": "decimal(38,18)", "decimal": "decimal(38,18)", "varchar": "string", "text": "string", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "uuid": "string", "json": "string", "jsonb": "variant", "bytea": "binary"}


def type_of(name: str) -> str:
    base = name.lower().strip()
    if base.endswith("[]"):
        return f"array<{type_of(base[:-2])}>"
    if base not in TYPES:
        raise ValueError(f"type {name}")
    return TYPES[base]


def register(spark: SparkSession, sf_dir: str) -> None:
    """The driver's tables as temporary views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def tables_in(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name) of the Parquet tables in a folder, as its file system lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found)
    return spark.createDataFrame([(n.removesuffix(".parquet"),) for n in names if n.endswith(".parquet")], "table_name string")


def columns_of(df: DataFrame, table: str) -> DataFrame:
    """The catalogue's column rows of one table."""
    rows = [(table, f.name, i + 1, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean")


class MaterializedView:
    """A view whose rows are kept; refreshing writes a new folder and then switches to it, so readers keep theirs."""

    def __init__(self, spark: SparkSession, name: str, sql: str, folder: str, with_data: bool = True):
        self.spark, self.name, self.sql, self.folder, self.version = spark, name, sql, folder, 0
        if with_data:
            self.refresh()

    def refresh(self) -> DataFrame:
        path = f"{self.folder}/{self.name}/v{self.version + 1}"
        self.spark.sql(self.sql).write.parquet(path)
        self.version += 1
        df = self.spark.read.parquet(path)
        df.createOrReplaceTempView(self.name)
        return df

    def read(self) -> DataFrame:
        if not self.version:
            raise ValueError(f"{self.name} has not been populated")
        return self.spark.read.parquet(f"{self.folder}/{self.name}/v{self.version}")


@dataclass
class Sequence:
    """A numbered source for keys. Bulk rows take a block of numbers at once."""

    increment: int = 1
    minimum: int | None = None
    maximum: int | None = None
    start: int | None = None
    cycle: bool = False
    last: int | None = None

    def __post_init__(self) -> None:
        if self.increment == 0:
            raise ValueError("increment is 0")
        up = self.increment > 0
        self.minimum = (1 if up else -(1 << 63)) if self.minimum is None else self.minimum
        self.maximum = ((1 << 63) - 1 if up else -1) if self.maximum is None else self.maximum
        self._next = (self.minimum if up else self.maximum) if self.start is None else self.start

    def nextval(self) -> int:
        if not self.minimum <= self._next <= self.maximum:
            if not self.cycle:
                raise ValueError("sequence is exhausted")
            self._next = self.minimum if self.increment > 0 else self.maximum
        self.last, self._next = self._next, self._next + self.increment
        return self.last

    def currval(self) -> int:
        if self.last is None:
            raise ValueError("sequence isn't used in this session")
        return self.last

    def setval(self, value: int, called: bool = True) -> int:
        """With `called` false the value itself comes next."""
        if not self.minimum <= value <= self.maximum:
            raise ValueError("out of bounds")
        self._next = value + self.increment if called else value
        if called:
            self.last = value
        return value

    def assign(self, df: DataFrame, column: str, order: str) -> DataFrame:
        """`df` with the next numbers, in order: the sequence moves on by its rows."""
        from heddle.operators.relational import chunks

        n, first = df.count(), self._next
        if n and not self.minimum <= first + (n - 1) * self.increment <= self.maximum:
            raise ValueError("sequence is exhausted")
        numbered = chunks(df, order, 1)
        self._next, self.last = first + n * self.increment, first + (n - 1) * self.increment if n else self.last
        return numbered.withColumn(column, F.lit(first) + F.col("chunk") * self.increment).drop("chunk")


@dataclass
class Constraint:
    """A rule of a table: kind primary, unique, check (a predicate) or foreign (columns, parent table and its columns, actions)."""

    kind: str
    columns: tuple[str, ...] = ()
    check: Column | None = None
    parent: str | None = None
    parent_columns: tuple[str, ...] = ()
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass
class Table:
    """A table's rows and what the catalogue knows of it."""

    rows: DataFrame
    defaults: dict[str, Column] = field(default_factory=dict)
    identity: dict[str, Sequence] = field(default_factory=dict)
    constraints: dict[str, Constraint] = field(default_factory=dict)
    indexes: dict[str, tuple[bool, tuple[str, ...]]] = field(default_factory=dict)
    stamps: dict[str, tuple[str, ...]] = field(default_factory=dict)


class CatalogError(ValueError):
    """A name that is there already or isn't there, a table that others reference, or rows that break a rule."""


class Database:
    """Named tables as frames, changed by statements. A statement that fails changes nothing.

    Secondary indexes are metadata: Spark prunes by partitions and footers. A unique one is a rule all the same.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.functions = spark, {}, {}

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise CatalogError(f"no table {name}")
        return self.tables[name]

    def create_table(self, name: str, rows: DataFrame | str, if_not_exists: bool = False, primary: tuple[str, ...] = (), defaults: dict[str, Column] | None = None, identity: dict[str, Sequence] | None = None) -> None:
        """CREATE TABLE: `rows` is a schema text, or the first rows."""
        if name in self.tables:
            if if_not_exists:
                return
            raise CatalogError(f"table {name} exists")
        rows = self.spark.createDataFrame([], rows) if isinstance(rows, str) else rows
        self.tables[name] = Table(rows, dict(defaults or {}), dict(identity or {}))
        if primary:
            try:
                self.add_constraint(name, f"{name}_pkey", Constraint("primary", primary))
            except CatalogError:
                del self.tables[name]
                raise

    def _children(self, name: str) -> list[tuple[str, str]]:
        return [(t, c) for t, x in self.tables.items() for c, k in x.constraints.items() if k.kind == "foreign" and k.parent == name and t != name]

    def drop_table(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        """DROP TABLE: with `cascade` the foreign keys that point to it go too."""
        if name not in self.tables:
            if if_exists:
                return
            raise CatalogError(f"no table {name}")
        children = self._children(name)
        if children and not cascade:
            raise CatalogError(f"{name} is referenced by {children[0][0]}")
        for t, c in children:
            del self.tables[t].constraints[c]
        del self.tables[name]

    def _broken(self, table: Table, rule: Constraint) -> DataFrame:
        from heddle.operators import relational as R

        if rule.kind == "primary":
            nulls = table.rows.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rule.columns])).select(*rule.columns)
            return R.duplicates(table.rows.select(*rule.columns), list(rule.columns)).select(*rule.columns).unionByName(nulls)
        if rule.kind == "unique":
            return R.duplicates(table.rows.select(*rule.columns), list(rule.columns))
        if rule.kind == "check":
            return R.check_violations(table.rows, rule.check)
        parent = self._table(rule.parent).rows.select(*[F.col(p).alias(f"__{c}") for c, p in zip(rule.columns, rule.parent_columns, strict=True)]).distinct()
        whole = table.rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule.columns]))
        return whole.join(parent, [F.col(c) == F.col(f"__{c}") for c in rule.columns], "left_anti").select(*rule.columns)

    def add_constraint(self, table: str, name: str, rule: Constraint) -> None:
        """ADD CONSTRAINT, ADD PRIMARY KEY: the rows there are must keep it."""
        t = self._table(table)
        if name in t.constraints:
            raise CatalogError(f"constraint {name} exists")
        if rule.kind == "primary" and any(c.kind == "primary" for c in t.constraints.values()):
            raise CatalogError(f"{table} has a primary key")
        if bad := self._broken(t, rule).limit(1).collect():
            raise CatalogError(f"{name}: {bad[0]}")
        t.constraints[name] = rule

    def drop_constraint(self, table: str, name: str, if_exists: bool = False) -> None:
        if self._table(table).constraints.pop(name, None) is None and not if_exists:
            raise CatalogError(f"no constraint {name}")

    def create_index(self, table: str, name: str, expressions: tuple[str, ...], unique: bool = False, if_not_exists: bool = False) -> None:
        """CREATE [UNIQUE] INDEX [CONCURRENTLY] over columns or JSON paths, written as SQL expressions."""
        if any(name in t.indexes for t in self.tables.values()):
            if if_not_exists:
                return
            raise CatalogError(f"index {name} exists")
        t = self._table(table)
        keys = [F.expr(e).alias(f"k{i}") for i, e in enumerate(expressions)]
        if unique:
            from heddle.operators import relational as R

            if bad := R.duplicates(t.rows.select(*keys), [f"k{i}" for i in range(len(keys))]).limit(1).collect():
                raise CatalogError(f"{name}: {bad[0]}")
        else:
            t.rows.select(*keys).schema  # noqa: B018  the expressions must be ones of the table
        t.indexes[name] = unique, expressions

    def drop_index(self, name: str, if_exists: bool = False) -> None:
        if not any(t.indexes.pop(name, None) for t in self.tables.values()) and not if_exists:
            raise CatalogError(f"no index {name}")

    def create_trigger(self, table: str, column: str, events: tuple[str, ...] = ("insert", "update")) -> None:
        """A BEFORE row trigger that sets NEW.column to now()."""
        self._table(table).stamps[column] = events

    def create_function(self, name: str, body: str, or_replace: bool = False) -> None:
        """CREATE [OR REPLACE] FUNCTION: the body is kept as text and never run."""
        if name in self.functions and not or_replace:
            raise CatalogError(f"function {name} exists")
        self.functions[name] = body

    def insert(self, table: str, rows: DataFrame | None = None, when: Column | None = None) -> None:
        """INSERT of rows, several, or (with none) DEFAULT VALUES: identities are numbered, defaults filled in, stamps set, rules kept, or nothing is written.

        `when` is what now() gives, the statement's time if it is left out.
        """
        t = self._table(table)
        rows = self.spark.range(1).select() if rows is None else rows
        for c, value in t.defaults.items():
            rows = rows.withColumn(c, F.coalesce(F.col(c), value) if c in rows.columns else value)
        counters = {c: replace(q) for c, q in t.identity.items()}
        for c, q in t.identity.items():
            counters[c].last, counters[c]._next = q.last, q._next
            if c not in rows.columns:
                rows = counters[c].assign(rows, c, rows.columns[0]) if rows.columns else rows.withColumn(c, F.lit(counters[c].nextval()))
        for c, events in t.stamps.items():
            if "insert" in events:
                rows = rows.withColumn(c, F.current_timestamp() if when is None else when)
        kept = t.rows.unionByName(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.rows.schema.fields]))
        self._check(table, replace(t, rows=kept))
        t.rows, t.identity = kept, counters

    def _check(self, name: str, table: Table) -> None:
        for rule, c in table.constraints.items():
            if bad := self._broken(table, c).limit(1).collect():
                raise CatalogError(f"{rule}: {bad[0]}")

    def truncate(self, *names: str, restart_identity: bool = False, cascade: bool = False) -> None:
        """TRUNCATE: RESTRICT refuses if other tables reference one of them, CASCADE empties those too; RESTART IDENTITY sets sequences back."""
        todo = list(names)
        for name in todo:
            self._table(name)
            for child, _ in self._children(name):
                if child not in todo:
                    if not cascade:
                        raise CatalogError(f"{name} is referenced by {child}")
                    todo.append(child)
        for name in todo:
            t = self.tables[name]
            t.rows = t.rows.limit(0)
            if restart_identity:
                t.identity = {c: replace(q, last=None) for c, q in t.identity.items()}

    def listing(self) -> DataFrame:
        """(table_name, kind, name, definition): columns, constraints, indexes, triggers, and functions under an empty table name."""
        out = []
        for t, x in self.tables.items():
            out += [(t, "column", f.name, f.dataType.simpleString()) for f in x.rows.schema.fields]
            out += [(t, c.kind, n, ",".join(c.columns) + (f" -> {c.parent}({','.join(c.parent_columns)}) on delete {c.on_delete} on update {c.on_update}" if c.parent else "")) for n, c in x.constraints.items()]
            out += [(t, "unique index" if u else "index", n, ",".join(e)) for n, (u, e) in x.indexes.items()]
            out += [(t, "trigger", c, ",".join(e)) for c, e in x.stamps.items()]
        out += [("", "function", n, body) for n, body in self.functions.items()]
        return self.spark.createDataFrame(out, "table_name string, kind string, name string, definition string")


def session_values(user: str = "heddle", database: str = "heddle") -> dict[str, str]:
    """What FROM-less probes of a session answer."""
    from heddle import __version__

    return {"version": f"heddle {__version__}", "current_database": database, "current_user": user, "session_user": user, "current_schema": "public"}


def bind(sql: str, parameters: list) -> tuple[str, dict]:
    """`$n` placeholders, outside literals, quoted names and comments, as named parameters for spark.sql."""
    import re

    used: dict[str, object] = {}

    def place(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        n = int(m[1])
        if not 1 <= n <= len(parameters):
            raise ValueError(f"parameter ${n}")
        used[f"p{n}"] = parameters[n - 1]
        return f":p{n}"

    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\$(\d+)", place, sql, flags=re.DOTALL), used
