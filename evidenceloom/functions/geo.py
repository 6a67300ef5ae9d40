"""Distances, circles, boxes and grid cells from latitude and longitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
CENTER = (48.3069, 14.2858)
DEFAULT_RADIUS_M, NEAR_RADIUS_M, SAME_PLACE_M = 15000.0, 5000.0, 300.0


def distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    x = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(x))


def within(lat: Column, lon: Column, center: tuple[float, float], radius_m: float) -> Column:
    """Known and inside the circle. A box around it stands first: it can be pushed to the scan and skips the trigonometry."""
    import math

    dlat = math.degrees(radius_m / EARTH_M) * 1.001
    dlon = math.degrees(radius_m / (EARTH_M * max(0.01, math.cos(math.radians(min(89.0, abs(center[0]) + dlat)))))) * 1.001
    box = lat.between(center[0] - dlat, center[0] + dlat) & lon.between(center[1] - dlon, center[1] + dlon)
    return box & (distance_m(F.lit(center[0]), F.lit(center[1]), lat, lon) <= radius_m)


def default_gate(lat: Column, lon: Column) -> Column:
    """Inside the default circle, or at an unknown place."""
    return lat.isNull() | lon.isNull() | within(lat, lon, CENTER, DEFAULT_RADIUS_M)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def geo_cell(lat: Column, lon: Column) -> Column:
    """Cell of about 500 m; empty if the place is unknown. Halves round to even."""
    cell = F.concat_ws(":", F.rint(lat * 200).cast("bigint"), F.rint(lon * 133).cast("bigint"))
    return F.when(lat.isNull() | lon.isNull(), "").otherwise(cell)
