"""Vectors as array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(v: Column, dim: int) -> Column:
    """Of the space's dimension (1 to 4096), finite throughout and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & F.lit(1 <= dim <= 4096) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Unit length, the norm taken in double and the parts kept in single precision."""
    n = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))  # a filter for valid vectors may be applied after this
    return F.transform(v, lambda x: (x.cast("double") / n).cast("float"))


def dot_constant(v: Column, query: list[float]) -> Column:
    """The dot product with a constant, spelled out so that it is compiled with the rest of the stage."""
    out = F.lit(0.0)
    for i, q in enumerate(query):
        out = out + F.get(v, F.lit(i)).cast("double") * F.lit(float(q))
    return out


def cosine_constant(unit: Column, query: list[float]) -> Column:
    """Cosine of a unit vector and a constant."""
    return dot_constant(unit, query) / F.lit(math.sqrt(sum(float(q) * float(q) for q in query)))
