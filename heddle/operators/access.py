"""Filtered reads in the style of REST parameters, and what a reader may see: row policies and masks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from heddle.functions.text import compare

_SIGNS = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


class FilterError(ValueError):
    """A parameter that can't be parsed."""


def split_top(text: str) -> list[str]:
    """The comma-separated parts of a list, commas within parentheses or double quotes apart."""
    parts, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                raise FilterError(text)
            if c == "," and depth == 0:
                parts.append(text[at:i])
                at = i + 1
    if depth or quoted:
        raise FilterError(text)
    return [*parts, text[at:]]


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text


class Filters:
    """Builds conditions on a table whose fields are columns, or keys of a JSON text column."""

    def __init__(self, df: DataFrame, json_col: str | None = None):
        self.df, self.json = df, json_col

    def field(self, name: str) -> tuple[Column, bool]:
        """The field, and if it is a native number."""
        if name in self.df.columns:
            return F.col(name), isinstance(self.df.schema[name].dataType, NumericType)
        if self.json is None:
            raise FilterError(f"no field {name}")
        return F.get_json_object(F.col(self.json), f"$.{name}"), False

    def condition(self, name: str, text: str) -> Column:
        """`field`, `op.value` or `not.op.value`."""
        op, dot, value = text.partition(".")
        if not dot:
            raise FilterError(text)
        if op == "not":
            return ~self.condition(name, value)
        c, native = self.field(name)
        if op in _SIGNS:
            right = F.lit(_unquoted(value))
            return compare(c.cast("string"), _SIGNS[op], right) if not native else {"=": c == right.cast("double"), "<>": c != right.cast("double"), "<": c < right.cast("double"), "<=": c <= right.cast("double"), ">": c > right.cast("double"), ">=": c >= right.cast("double")}[_SIGNS[op]]
        if op in ("like", "ilike"):
            return getattr(c.cast("string"), op)(value.replace("*", "%"))
        if op == "in" and value.startswith("(") and value.endswith(")"):
            return c.cast("string").isin(*map(_unquoted, split_top(value[1:-1])))
        if op == "is" and value in ("null", "true", "false"):
            return c.isNull() if value == "null" else c.cast("boolean").eqNullSafe(F.lit(value == "true"))
        raise FilterError(text)

    def group(self, kind: str, text: str) -> Column:
        """`or` or `and` of a list in parentheses: conditions, and groups again."""
        if not (text.startswith("(") and text.endswith(")")):
            raise FilterError(text)
        out = None
        for part in split_top(text[1:-1]):
            if m := re.fullmatch(r"(not\.)?(and|or)(\(.*\))", part, re.DOTALL):
                c = self.group(m[2], m[3])
                c = ~c if m[1] else c
            else:
                name, _, rest = part.partition(".")
                c = self.condition(name, rest)
            out = c if out is None else (out | c if kind == "or" else out & c)
        if out is None:
            raise FilterError(text)
        return out

    def where(self, parameters: list[tuple[str, str]]) -> Column:
        out = F.lit(True)
        for name, text in parameters:
            out = out & (self.group(name, text) if name in ("and", "or") else self.condition(name, text))
        return out

    def order(self, text: str) -> list[Column]:
        """`a.asc,b.desc.nullslast`; nulls come last ascending and first descending unless said."""
        out = []
        for part in split_top(text):
            name, *flags = part.split(".")
            if not set(flags) <= {"asc", "desc", "nullsfirst", "nullslast"}:
                raise FilterError(part)
            c, down = self.field(name)[0], "desc" in flags
            first = "nullsfirst" in flags or (down and "nullslast" not in flags)
            out.append(getattr(c, f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")())
        return out

    def select(self, text: str) -> list[Column]:
        """`a,alias:b`, or `*`."""
        if text == "*":
            return [F.col(c) for c in self.df.columns]
        out = []
        for part in split_top(text):
            alias, colon, name = part.partition(":")
            out.append(self.field(name if colon else alias)[0].alias(alias))
        return out


def rest_read(df: DataFrame, parameters: list[tuple[str, str]] = (), select: str = "*", order: str | None = None, limit: int | None = 100, offset: int = 0, json_col: str | None = None) -> DataFrame:
    """A filtered, ordered page. Filters come before the limit, so hidden rows never shorten a page."""
    f = Filters(df, json_col)
    out = df.where(f.where(list(parameters)))
    if order:
        out = out.orderBy(*f.order(order))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*f.select(select))


def rest_count(df: DataFrame, parameters: list[tuple[str, str]], json_col: str | None = None) -> DataFrame:
    """The exact count beside a page."""
    return df.where(Filters(df, json_col).where(parameters)).agg(F.count(F.lit(1)).alias("count"))


def graphql_read(table: DataFrame, query: str, key_col: str) -> DataFrame:
    """`{ t(key: "k") { a b } }` or `{ t(limit: n) { a b } }`: a point read or the first rows by key."""
    m = re.fullmatch(r"\s*\{?\s*\w+\s*\(\s*(key|limit)\s*:\s*(\"[^\"]*\"|\d+)\s*\)\s*\{([\w\s,]*)\}\s*\}?\s*", query)
    if not m:
        raise FilterError(query)
    fields = re.findall(r"\w+", m[3])
    rows = table.where(F.col(key_col).cast("string") == m[2].strip('"')) if m[1] == "key" else table.orderBy(key_col).limit(int(m[2]))
    return rows.select(*fields)


def tenant_visible(value: Column, column: str, tenant: str) -> Column:
    """A JSON object whose one field of that name, in any case, is the tenant's text; anything else is hidden."""
    kinds = F.from_json(value, "map<string,variant>")
    named = F.filter(F.map_entries(kinds), lambda e: F.lower(e["key"]) == column.lower())
    is_text = F.schema_of_variant(F.get(named, F.lit(0))["value"]) == "STRING"
    return F.coalesce((F.size(named) == 1) & is_text & (F.try_variant_get(F.get(named, F.lit(0))["value"], "$", "string") == tenant), F.lit(False))


def owner_visible(policies: list[Callable[[str], Column]] | None, uid: str) -> Column:
    """Permissive policies are OR-ed; with row security on and no policy nothing is visible; None: row security is off."""
    if policies is None:
        return F.lit(True)
    out = F.lit(False)
    for p in policies:
        out = out | F.coalesce(p(uid), F.lit(False))
    return out


def masked(value: Column, fields: list[str]) -> Column:
    """The JSON object with the listed fields, where present, as "***"; any other value is "***" as a whole."""
    parsed = F.from_json(value, "map<string,variant>")
    entries = F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"].isin(*fields), F.lit('"***"')).otherwise(F.to_json(e["value"])).alias("value")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(F.concat(F.lit('"'), F.replace(F.replace(e["key"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":')), e["value"])), ","), F.lit("}"))
    is_object = F.coalesce(F.trim(value).startswith("{") & F.try_parse_json(value).isNotNull(), F.lit(False))
    return F.when(is_object, text).otherwise(F.lit("***"))
