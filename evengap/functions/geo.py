"""Coordinates: weather grid cells, Web Mercator metres, map tile indexes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0  # fixed value: Web Mercator sphere


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grid_key(degrees) -> Column:
    """Decidegree integer of a coordinate: an exact join key where a rounded double is not."""
    return F.round(_col(degrees) * 10).cast("int")


def web_mercator_x(lon) -> Column:
    return F.radians(_col(lon)) * EARTH_RADIUS_M


def web_mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(_col(lat)) / 2)) * EARTH_RADIUS_M


def tile_x(lon, zoom: int) -> Column:
    return (_col(lon) + 180.0) / 360.0 * float(2**zoom)


def tile_y(lat, zoom: int) -> Column:
    return (1.0 - F.asinh(F.tan(F.radians(_col(lat)))) / math.pi) / 2.0 * float(2**zoom)
