"""JSON paths and array literals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(steps: tuple[str | int, ...]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)


def json_value(document: Column, *steps: str | int) -> Column:
    """`document -> step -> ...`: the JSON text of what a chain of fields and positions leads to; null if it leads nowhere."""
    found = F.try_variant_get(F.try_parse_json(document), _path(steps), "variant")
    return F.to_json(found)


def json_text(document: Column, *steps: str | int) -> Column:
    """`document -> ... ->> step`: the same as text, a string without its quotes, JSON null as null."""
    variant = F.try_parse_json(document)
    plain = F.try_variant_get(variant, _path(steps), "string")
    whole = F.to_json(F.try_variant_get(variant, _path(steps), "variant"))
    return F.coalesce(plain, F.when(whole != "null", whole))


def brace_array(literal: Column) -> Column:
    """The array of strings that a literal such as {a,"b, c",NULL} stands for; null for other text."""
    inner = F.regexp_extract(literal, r"(?s)^\s*\{(.*)\}\s*$", 1)
    items = F.regexp_extract_all(inner, F.lit(r'(?s)"((?:[^"\\]|\\.)*)"|([^,"]+)'), F.lit(0))
    # of text that isn't quoted, blanks between items are none
    items = F.filter(items, lambda x: F.trim(x) != "")
    plain = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"(?s)\\(.)", "$1")
    value = lambda x: F.when(x.startswith('"'), plain(x)).when(F.upper(F.trim(x)) == "NULL", F.lit(None)).otherwise(F.trim(x))
    return F.when(literal.rlike(r"(?s)^\s*\{.*\}\s*$"), F.transform(items, value))
