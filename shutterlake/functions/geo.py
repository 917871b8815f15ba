"""Web-mercator pixels for grid aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_PIXELS = 256
MAX_LATITUDE = 85.0511287798


def pixel_x(longitude: Column, zoom: int) -> Column:
    return (longitude + 180.0) / 360.0 * float(TILE_PIXELS * 2**zoom)


def pixel_y(latitude: Column, zoom: int) -> Column:
    clamped = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), latitude))
    angle = F.radians(clamped)
    y = F.lit(0.5) - F.log(F.tan(angle) + 1 / F.cos(angle)) / (2 * math.pi)
    return y * float(TILE_PIXELS * 2**zoom)
