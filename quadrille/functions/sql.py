"""Tile arithmetic under names of SQL: scalar functions and a table function, all of the SQL language.

``register(spark)`` makes them for the session; Catalyst puts their bodies in place, so they cost what
the expressions cost. ``tiles_for_bounds`` is a table function, used with LATERAL::

    select k, t.* from boxes, lateral tiles_for_bounds(6, min_x, min_y, max_x, max_y) t
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import mercator as M

R, OS, LAT = (f"{v!r}D" for v in (M.EARTH_RADIUS_M, M.ORIGIN_SHIFT_M, M.MAX_LATITUDE_DEG))
EPS = "1e-9D * tile_span(zoom)"

#: (signature, what it returns, body), in an order in which each needs those before it alone.
FUNCTIONS = (
    ("mercator_x(lon double)", "double", f"radians(lon) * {R}"),
    ("mercator_y(lat double)", "double", f"ln(tan(pi() / 4 + radians(least(greatest(lat, -{LAT}), {LAT})) / 2)) * {R}"),
    ("mercator_lon(mx double)", "double", f"degrees(mx / {R})"),
    ("mercator_lat(my double)", "double", f"degrees(2 * atan(exp(my / {R})) - pi() / 2)"),
    ("tiles_per_axis(zoom int)", "bigint", "shiftleft(1L, zoom)"),
    ("tile_span(zoom int)", "double", f"2 * {OS} / pow(2D, zoom)"),
    ("tile_resolution(zoom int, tile_size int)", "double", f"2 * {OS} / (tile_size * pow(2D, zoom))"),
    ("zoom_for_resolution(metres double)", "int", f"coalesce(get(filter(sequence(0, {M.MAX_ZOOM}), z -> 2 * {OS} / ({M.TILE_SIZE} * pow(2D, z)) <= metres), 0), {M.MAX_ZOOM})"),
    ("tile_x(zoom int, mx double)", "bigint", f"least(greatest(cast(floor((mx + {OS}) / tile_span(zoom)) as bigint), 0L), tiles_per_axis(zoom) - 1)"),
    ("tile_y(zoom int, my double)", "bigint", f"least(greatest(cast(floor(({OS} - my) / tile_span(zoom)) as bigint), 0L), tiles_per_axis(zoom) - 1)"),
    ("tms_row(zoom int, y bigint)", "bigint", "tiles_per_axis(zoom) - 1 - y"),
    ("tile_min_x(zoom int, x bigint)", "double", f"x * tile_span(zoom) - {OS}"),
    ("tile_max_y(zoom int, y bigint)", "double", f"{OS} - y * tile_span(zoom)"),
    ("tile_range(zoom int, min_x double, min_y double, max_x double, max_y double)", "struct<x_min:bigint,x_max:bigint,y_min:bigint,y_max:bigint>",
     f"named_struct('x_min', tile_x(zoom, min_x), 'x_max', greatest(tile_x(zoom, max_x - {EPS}), tile_x(zoom, min_x)), 'y_min', tile_y(zoom, max_y), 'y_max', greatest(tile_y(zoom, min_y + {EPS}), tile_y(zoom, max_y)))"),
)
TABLE_FUNCTION = """create or replace temporary function tiles_for_bounds(zoom int, min_x double, min_y double, max_x double, max_y double) returns table(x bigint, y bigint)
return select col.x, row.y from (select tile_range(zoom, min_x, min_y, max_x, max_y) r), lateral explode(sequence(r.x_min, r.x_max)) col(x), lateral explode(sequence(r.y_min, r.y_max)) row(y)"""


def register(spark: SparkSession) -> list[str]:
    """Makes the functions temporary functions of the session, and returns their names."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {signature} returns {kind} return {body}")
    spark.sql(TABLE_FUNCTION)
    return [signature.partition("(")[0] for signature, _, _ in FUNCTIONS] + ["tiles_for_bounds"]
