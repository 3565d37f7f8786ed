"""Expiry stamps: unix seconds, or unix milliseconds with the top bit of the 64 set; 0 is never."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = (1 << 63) - 1


def at_millis(millis: Column) -> Column:
    """The stamp of a time in milliseconds; as a signed long it is negative."""
    return millis.cast("long").bitwiseOR(F.lit(-(1 << 63)))


def to_millis(stamp: Column) -> Column:
    return F.when(stamp < 0, stamp.bitwiseAND(F.lit(_LOW))).otherwise(stamp * 1000)


def expired(stamp: Column, now_millis: Column | int) -> Column:
    now = F.lit(now_millis) if isinstance(now_millis, int) else now_millis
    return (stamp != 0) & (to_millis(stamp) <= now)


def remaining(stamp: Column, now_millis: Column | int) -> Column:
    """Milliseconds left, at least 0; null for never."""
    now = F.lit(now_millis) if isinstance(now_millis, int) else now_millis
    return F.when(stamp != 0, F.greatest(F.lit(0), to_millis(stamp) - now))


def ttl(stamp: Column, now_millis: int) -> Column:
    """Milliseconds left, -1 for a key that stays, -2 for a missing or expired one (a null stamp is a missing key)."""
    return F.when(stamp.isNull() | expired(stamp, now_millis), F.lit(-2)).when(stamp == 0, F.lit(-1)).otherwise(to_millis(stamp) - now_millis)
