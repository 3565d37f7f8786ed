"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, given by an offset and a
step. Shards take turns, in proportion to their weights, claiming their next free slot until the
table is full. A row's slot is its key's hash modulo the table's size, so placement is one lookup,
shards get even shares, and removing a shard moves few rows of the others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import fresh

#: Prime size of the table; it bounds what is broadcast, and should be over 100 times the shards.
TABLE_SIZE = 65_537
MAX_TABLE = 4_000_037


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(shard: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{shard}".encode()).digest()[:8], "big")


def lookup_table(shards: dict[str, int] | list[str], size: int = TABLE_SIZE) -> list[str]:
    """Slot -> shard. `shards`: names, or names with positive whole weights (claims a round)."""
    if not is_prime(size) or size > MAX_TABLE:
        raise ValueError(f"size must be a prime of at most {MAX_TABLE}")
    weights = dict(shards) if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or len(weights) > size or min(weights.values()) < 1:
        raise ValueError("give 1 to `size` shards, with weights of 1 or more")
    order = sorted(weights)
    offset = {s: _number(s, "offset") % size for s in order}
    step = {s: _number(s, "step") % (size - 1) + 1 for s in order}
    nexts = dict.fromkeys(order, 0)
    table: list[str | None] = [None] * size
    free = size
    while free:
        for s in order:
            for _ in range(weights[s]):
                if not free:
                    break
                while table[at := (offset[s] + nexts[s] * step[s]) % size] is not None:
                    nexts[s] += 1
                table[at] = s
                nexts[s] += 1
                free -= 1
    return table  # type: ignore[return-value]


def slot_of(key, size: int = TABLE_SIZE):
    """A key's slot: 60 bits of the MD5 of its text, modulo the size; a null key counts as the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, key_col: str, shards: dict[str, int] | list[str], size: int = TABLE_SIZE, slot_col: str = "__slot", shard_col: str = "__shard") -> DataFrame:
    """`df` with `slot_col` and `shard_col`. No shuffle: the table, of `size` short rows, is broadcast.

    Null keys share one slot, equal keys one shard; repeated rows and other columns stay, but columns
    so named give way; an empty table stays empty.
    """
    others = [c for c in df.columns if c not in (slot_col, shard_col)]
    slot, at, shard = fresh(df, "__s", "__at", "__sh")
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, size))), f"{at} int, {shard} string")
    return df.withColumn(slot, slot_of(F.col(key_col), size)).join(F.broadcast(table), F.col(slot) == F.col(at)).select(*others, F.col(slot).alias(slot_col), F.col(shard).alias(shard_col))


def production_shards(n: int = 64) -> dict[str, int]:
    """Shards 0 to n-1; every eighth is on a machine of twice the size."""
    return {f"shard-{i:03d}": 2 if i % 8 == 0 else 1 for i in range(n)}


def op8_shard_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs, "doc_id", production_shards(), slot_col="slot", shard_col="shard")
