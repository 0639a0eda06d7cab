"""Web Mercator and tile arithmetic as Column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the projection and the tile scheme.
EARTH_RADIUS_M = 6378137.0
ORIGIN_SHIFT_M = math.pi * EARTH_RADIUS_M
MAX_LATITUDE_DEG = 85.05112877980659
TILE_SIZE = 256
MAX_ZOOM = 30


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def mercator_x(lon) -> Column:
    return F.radians(_col(lon)) * EARTH_RADIUS_M


def mercator_y(lat) -> Column:
    return F.ln(F.tan(math.pi / 4 + F.radians(clamp(lat, -MAX_LATITUDE_DEG, MAX_LATITUDE_DEG)) / 2)) * EARTH_RADIUS_M


def _northings(lat: pa.Array) -> pa.Array:
    held = (None if v is None else min(max(v, -MAX_LATITUDE_DEG), MAX_LATITUDE_DEG) for v in lat.to_pylist())
    return pa.array([v if v is None or v != v else math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) * EARTH_RADIUS_M for v in held], pa.float64())


def northing(lat) -> Column:
    """mercator_y by the C library, as SQL engines outside the JVM compute it. The JVM's logarithms and tangents
    differ from it in the last bit, which counts where a point on an area's edge is tested."""
    return F.arrow_udf(_northings, "double")(_col(lat))


def longitude(mx) -> Column:
    return F.degrees(_col(mx) / EARTH_RADIUS_M)


def latitude(my) -> Column:
    return F.degrees(2 * F.atan(F.exp(_col(my) / EARTH_RADIUS_M)) - math.pi / 2)


def tiles_per_axis(z) -> Column:
    return F.pow(F.lit(2.0), _col(z)).cast("long")


def span(z) -> Column:
    """Metres along a tile's edge."""
    return F.lit(2 * ORIGIN_SHIFT_M) / F.pow(F.lit(2.0), _col(z))


def resolution(z, tile_size: int = TILE_SIZE) -> Column:
    return F.lit(2 * ORIGIN_SHIFT_M) / (tile_size * F.pow(F.lit(2.0), _col(z)))


def zoom_for_resolution(metres, tile_size: int = TILE_SIZE) -> Column:
    """The smallest zoom whose pixels are no larger, at most MAX_ZOOM."""
    fine = F.filter(F.sequence(F.lit(0), F.lit(MAX_ZOOM)), lambda z: resolution(z, tile_size) <= _col(metres))
    return F.coalesce(F.get(fine, F.lit(0)), F.lit(MAX_ZOOM))


def tms_row(z, y) -> Column:
    return tiles_per_axis(z) - 1 - _col(y)


def tile_bounds_m(z, x, y) -> tuple[Column, Column, Column, Column]:
    """(min_x, min_y, max_x, max_y) in metres."""
    s = span(z)
    min_x, max_y = _col(x) * s - ORIGIN_SHIFT_M, ORIGIN_SHIFT_M - _col(y) * s
    return min_x, max_y - s, min_x + s, max_y


def tile_x(z, mx) -> Column:
    return _clamped(F.floor((_col(mx) + ORIGIN_SHIFT_M) / span(z)), z)


def tile_y(z, my) -> Column:
    return _clamped(F.floor((ORIGIN_SHIFT_M - _col(my)) / span(z)), z)


def _clamped(tile: Column, z) -> Column:
    return F.least(F.greatest(tile.cast("long"), F.lit(0).cast("long")), tiles_per_axis(z) - 1)


def tile_range(z, min_x, min_y, max_x, max_y) -> tuple[Column, Column, Column, Column]:
    """(x_min, x_max, y_min, y_max), inclusive. Far edges are drawn in by a billionth of a tile, so that a
    box ending on a tile's edge does not reach the next tile; a box without extent keeps its own tile."""
    eps = span(z) * 1e-9
    x_min, y_min = tile_x(z, min_x), tile_y(z, max_y)
    return x_min, F.greatest(tile_x(z, _col(max_x) - eps), x_min), y_min, F.greatest(tile_y(z, _col(min_y) + eps), y_min)


def native_resolution(cell, crs: str) -> Column:
    """Metres of a cell at the equator."""
    return _col(cell) if crs == "3857" else _col(cell) * ORIGIN_SHIFT_M / 180.0
