"""Great-circle distance and bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leasegrain.config import EARTH_RADIUS_MI


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2.0 * EARTH_RADIUS_MI) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def placeable(lat: Column, lng: Column) -> Column:
    """Whether a point can be drawn: present, finite, and not (0, 0)."""
    infinite = F.lit(float("inf"))
    finite = (
        lat.isNotNull()
        & lng.isNotNull()
        & ~F.isnan(lat)
        & ~F.isnan(lng)
        & (F.abs(lat) != infinite)
        & (F.abs(lng) != infinite)
    )
    return F.coalesce(finite & ~((lat == 0.0) & (lng == 0.0)), F.lit(False))


#: Bits per axis of a cell number: about 0.2 miles of latitude.
CELL_BITS = 16


def _spread_bits(value: Column) -> Column:
    """The low 16 bits of a number, each moved to twice its place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return value


def cell_row(lat: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << CELL_BITS) - 1), F.floor((lat + 90.0) / 180.0 * (1 << CELL_BITS)))).cast("bigint")


def cell_column(lng: Column) -> Column:
    """Without wrapping: numbers that differ by ``1 << CELL_BITS`` are the same place."""
    return F.floor((lng + 180.0) / 360.0 * (1 << CELL_BITS)).cast("bigint")


def cell_number(row: Column, column: Column) -> Column:
    """Rows and columns as one number, their bits alternating.

    A cell of ``k`` bits per axis is the range of the numbers that start with its
    ``2 k`` bits, so leaving out low bits gives the larger cell around a place.
    """
    return F.shiftleft(_spread_bits(row), 1).bitwiseOR(_spread_bits(F.pmod(column, F.lit(1 << CELL_BITS).cast("bigint"))))
