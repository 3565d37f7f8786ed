"""Text columns: globs, tokens, numeric-aware comparison, COPY escapes, statement fingerprints, stream ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """A key glob (`*`, `?`, `[a-c]`, `[^x]`, backslash escapes) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            inside = "".join("\\" + x if x in "\\[]^&" else x for x in body[negated:])
            out.append(f"[{'^' if negated else ''}{inside}]" if inside else "(?!)")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits, in order; empty for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def compare(left: Column, op: str, right: Column) -> Column:
    """Numeric-aware comparison of two strings: as numbers when both are, else as text."""
    a, b = left.try_cast("double"), right.try_cast("double")
    signs = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    return F.when(a.isNotNull() & b.isNotNull(), signs[op](a, b)).otherwise(signs[op](left, right))


def copy_escape(value: Column) -> Column:
    r"""A field of COPY text: backslash, tab and line ends escaped, null as \N."""
    v = value.cast("string")
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        v = F.replace(v, F.lit(plain), F.lit(escaped))
    return F.coalesce(v, F.lit("\\N"))


def copy_unescape(field: Column, keep_unknown: bool = False) -> Column:
    r"""The value of a COPY field, \N as null. `keep_unknown`: an unknown escape keeps its backslash, and \N is text."""
    mark = "\x00"
    v = F.replace(field, F.lit("\\\\"), F.lit(mark))
    for escaped, plain in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        v = F.replace(v, F.lit(escaped), F.lit(plain))
    if not keep_unknown:
        v = F.regexp_replace(v, r"\\(.)", "$1")
    v = F.replace(v, F.lit(mark), F.lit("\\"))
    return v if keep_unknown else F.when(field == "\\N", F.lit(None)).otherwise(v)


def fingerprint(sql: Column) -> Column:
    """A statement in upper case with literals and whole numbers as `?` and even spaces."""
    q = F.regexp_replace(sql, "'[^']*'|\"[^\"]*\"", "?")
    q = F.regexp_replace(F.upper(q), r"(?<![\p{L}\p{N}_.])[0-9]+(?![\p{L}\p{N}_.])", "?")
    q = F.regexp_replace(q, r"\s*([,;()=])\s*", " $1 ")
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def stream_id(value: Column) -> Column:
    """`ms-seq` as a struct of two longs, which compares as stream ids do; a bare `ms` has seq 0."""
    part = F.split(value, "-")
    return F.struct(F.element_at(part, 1).cast("long").alias("ms"), F.coalesce(F.try_element_at(part, F.lit(2)).cast("long"), F.lit(0)).alias("seq"))
