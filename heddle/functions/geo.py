"""Positions on the earth as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the earth's radius in metres, the latitude limit of scores, metres in a unit, the geohash alphabet
EARTH_RADIUS_M = 6372797.560856
LAT_LIMIT = 85.05112878
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "ft": 0.3048}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two positions."""
    rad = F.radians
    chord = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(chord))


def _metres(lon1: float | None, lat1: float | None, lon2: float | None, lat2: float | None) -> float | None:
    if None in (lon1, lat1, lon2, lat2):
        return None
    if not all(map(math.isfinite, (lon1, lat1, lon2, lat2))):
        return math.nan
    rad, sin, cos = math.radians, math.sin, math.cos
    chord = math.pow(sin(rad(lat2 - lat1) / 2), 2) + cos(rad(lat1)) * cos(rad(lat2)) * math.pow(sin(rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(chord)))


def library_haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """haversine by the C library's functions, as SQL engines in C take them: the JVM's differ from them in the last bits, which texts show."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array([_metres(*x) for x in zip(*(v.to_pylist() for v in (a, b, c, d)))], pa.float64())

    return run(*(x.cast("double") for x in (lon1, lat1, lon2, lat2)))


def distance_text(metres: Column, unit: str = "m") -> Column:
    """A distance with four decimals in m, km, mi or ft, rounded by its exact binary value, as C does, not by its shortest decimal one."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.4f}" for v in x.to_pylist()], pa.string())

    return run((metres / UNITS[unit.lower()]).cast("double"))


def _cell(value: Column, low: float, high: float, bits: int) -> Column:
    cell = F.floor((value - low) / (high - low) * F.lit(float(1 << bits))).cast("long")
    return F.least(cell, F.lit((1 << bits) - 1))


def _spread(lon: Column, lat: Column, bits: int) -> Column:
    """Bits of two cells, the longitude's first, interleaved."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(lon, k).bitwiseAND(F.lit(1).cast("long")), 2 * k + 1))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(lat, k).bitwiseAND(F.lit(1).cast("long")), 2 * k))
    return out


def score(lon: Column, lat: Column) -> Column:
    """The 52-bit interleaved cell that orders positions."""
    return _spread(_cell(lon, -180.0, 180.0, 26), _cell(lat, -LAT_LIMIT, LAT_LIMIT, 26), 26)


def geohash(lon: Column, lat: Column) -> Column:
    """Eleven letters: ten of 50 bits, over latitudes of 90 degrees, and a zero."""
    bits = _spread(_cell(lon, -180.0, 180.0, 25), _cell(lat, -90.0, 90.0, 25), 25)
    letters = [F.substring(F.lit(ALPHABET), (F.shiftright(bits, 45 - 5 * k).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for k in range(10)]
    return F.concat(*letters, F.lit("0"))


def _gather(value: Column, bits: int) -> Column:
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value, 2 * k).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def decode_score(value: Column) -> Column:
    """The middle (lon, lat) of a score's cell."""
    lon, lat = _gather(F.shiftright(value, 1), 26), _gather(value, 26)
    at = lambda cell, low, high: (cell + 0.5) / float(1 << 26) * (high - low) + low
    return F.struct(at(lon, -180.0, 180.0).alias("lon"), at(lat, -LAT_LIMIT, LAT_LIMIT).alias("lat"))


def valid(lon: Column, lat: Column) -> Column:
    return lon.between(-180.0, 180.0) & lat.between(-LAT_LIMIT, LAT_LIMIT)


def in_box(lon: Column, lat: Column, lon0: Column, lat0: Column, width: float, height: float, degrees_as_radians: bool = False) -> Column:
    """If a position is in the box of `width` and `height` metres around the centre.

    `degrees_as_radians` takes the cosine of the centre's latitude without conversion, as a known peer does.
    """
    shrink = F.cos(lat0 if degrees_as_radians else F.radians(lat0))
    dx, dy = F.radians(lon - lon0) * shrink * EARTH_RADIUS_M, F.radians(lat - lat0) * EARTH_RADIUS_M
    return (F.abs(dx) * 2 <= width) & (F.abs(dy) * 2 <= height)
