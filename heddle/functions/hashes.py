"""Hashes whose bits matter to a result, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the 64-bit FNV-1a offset and prime
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a64_int(data: bytes, start: int = OFFSET) -> int:
    for b in data:
        start = ((start ^ b) * PRIME) & MASK
    return start


def fnv1a64(value: Column) -> Column:
    """FNV-1a of the text's UTF-8 bytes as 16 hex digits; null for null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f"{fnv1a64_int(x.encode()):016x}")

    return run(value.cast("string"))


def route(value: Column, partitions: int) -> Column:
    """The FNV-1a hash modulo the partitions."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fnv1a64_int(x.encode()) % partitions).astype("Int32")

    return run(value.cast("string"))
