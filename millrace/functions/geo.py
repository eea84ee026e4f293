"""Geohash and unit-sphere coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators.columns import as_column

# Fixed value: the base-32 digits of geohashes.
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
PRECISION = 9


def _cell(c: Column, low: float, high: float, bits: int) -> Column:
    cells = 1 << bits
    return F.least(F.lit(cells - 1), F.floor((c - low) / (high - low) * cells).cast("long"))


def geohash(lat: Column | str, lon: Column | str, precision: int = PRECISION) -> Column:
    """Base-32 cell of a point; null where a coordinate is null or out of range.

    Longitude and latitude become integer cells whose bits alternate, longitude first.
    """
    lat, lon = as_column(lat).cast("double"), as_column(lon).cast("double")
    bits = 5 * precision
    x, y = _cell(lon, -180.0, 180.0, (bits + 1) // 2), _cell(lat, -90.0, 90.0, bits // 2)
    turn = (bits + 1) % 2  # an even number of bits ends with latitude

    def digit(i: int) -> Column:
        found = F.lit(0)
        for k in range(5):
            place = bits - 1 - (5 * i + k)  # of the bit, from the right
            source = x if (place + turn) % 2 == 0 else y
            found = found + F.shiftright(source, place // 2).bitwiseAND(F.lit(1).cast("long")) * (1 << (4 - k))
        return F.substr(F.lit(DIGITS), (found + 1).cast("int"), F.lit(1))

    fits = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(fits, F.concat(*(digit(i) for i in range(precision))))


def geohash_levels(finest: Column | str, levels: range = range(2, 10)) -> dict[str, Column]:
    """Coarser cells are prefixes of the finest."""
    return {f"geohash_{n}": F.substring(as_column(finest), 1, n) for n in levels}


def cartesian(lat: Column | str, lon: Column | str) -> tuple[Column, Column, Column]:
    phi, theta = F.radians(as_column(lat)), F.radians(as_column(lon))
    return F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)
