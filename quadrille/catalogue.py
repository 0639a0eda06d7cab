"""Queries over the test tables for the map-tile operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import mercator as M
from .operators import raster, spatial_index, vector
from .plans import tileset, views
from .plans.options import CogOptions, MvtOptions, PyramidOptions
from .plans.shared import shared_folder, shared_path
from .sinks import cog, files, tile_index, xyz
from .sinks import shapefile as shapefiles
from .sources import geojson, geotiff, shapefile
from .streaming.tiles import binned

OS = repr(M.ORIGIN_SHIFT_M)
R = repr(M.EARTH_RADIUS_M)
MAXLAT = repr(M.MAX_LATITUDE_DEG)
AREA_ZOOM, SAMPLE_ZOOM = 8, 15
#: Means of prices in cents often end in a half of the last digit kept; this moves them away from it.
AWAY = 1.37e-07


def mx(lon: str) -> str:
    return f"(radians({lon}) * {R})"


def my(lat: str) -> str:
    return f"(ln(tan(pi() / 4 + radians(least(greatest({lat}, -{MAXLAT}), {MAXLAT})) / 2)) * {R})"


def lon(m: str) -> str:
    return f"degrees({m} / {R})"


def lat(m: str) -> str:
    return f"degrees(2 * atan(exp({m} / {R})) - pi() / 2)"


def span(z: str) -> str:
    return f"(2 * {OS} / pow(2.0::double, {z}))"


def clamped(v: str, z: str) -> str:
    return f"least(greatest({v}::bigint, 0), (pow(2, {z}) - 1)::bigint)"


def range_sql(z: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Columns x_min, x_max, y_min, y_max of a box in metres."""
    left, top = clamped(f"floor(({x0} + {OS}) / {span(z)})", z), clamped(f"floor(({OS} - {y1}) / {span(z)})", z)
    right, bottom = clamped(f"floor(({x1} - {span(z)} * 1e-9::double + {OS}) / {span(z)})", z), clamped(f"floor(({OS} - ({y0} + {span(z)} * 1e-9::double)) / {span(z)})", z)
    return f"{left} x_min, greatest({right}, {left}) x_max, {top} y_min, greatest({bottom}, {top}) y_max"


ZOOMS = "(select unnest(generate_series({}, {}))::int z)"
BOX_M = f"""b as ({views.BOXES}), m as (select k, {mx('lon')} x0, {my('lat')} y0, {mx('(lon + w)')} x1, {my('(lat + w)')} y1 from b)"""
PT_M = f"p as ({views.PTS}), m as (select k, {mx('lon')} mx, {my('lat')} my from p)"
GRID_ROWS = f"(select max(r) + 1 from ({views.GRID}))"
GRID_META = f"g as ({views.GRID}), meta as (select {GRID_ROWS} n)"
OX, OY, CELL = views.ORIGIN_X, views.ORIGIN_Y, views.CELL


def _pts(spark, d):
    return views.view(spark, d, views.PTS, "customer")


def _boxes_m(spark, d, y=M.mercator_y) -> DataFrame:
    b = views.view(spark, d, views.BOXES, "supplier")
    return b.select("k", M.mercator_x("lon").alias("min_x"), y("lat").alias("min_y"), M.mercator_x(F.col("lon") + F.col("w")).alias("max_x"), y(F.col("lat") + F.col("w")).alias("max_y"))


def tile_point_counts(spark: SparkSession, d: str) -> DataFrame:
    return binned(_pts(spark, d), 0, 6).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


TILE_POINT_COUNTS = f"with {PT_M} select z, {clamped(f'floor((mx + {OS}) / {span('z')})', 'z')} x, {clamped(f'floor(({OS} - my) / {span('z')})', 'z')} y, count(*) n from m, {ZOOMS.format(0, 6)} group by all"


def mercator_forward(spark, d):
    return _pts(spark, d).select("k", F.round(M.mercator_x("lon"), 3).alias("mx"), F.round(M.mercator_y("lat"), 3).alias("my"))


def mercator_inverse(spark, d):
    return _pts(spark, d).select("k", F.round(M.longitude(M.mercator_x("lon")), 8).alias("lon"), F.round(M.latitude(M.mercator_y("lat")), 8).alias("lat"))


def _all_tiles(spark, top: int) -> DataFrame:
    z = spark.range(top + 1).select(F.col("id").cast("int").alias("z"))
    side = F.sequence(F.lit(0).cast("long"), M.tiles_per_axis("z") - 1)
    return z.withColumn("x", F.explode(side)).withColumn("y", F.explode(side))


def _point_tiles(spark, d) -> DataFrame:
    """The tile of each point at a zoom of its own."""
    p = _pts(spark, d).select("k", (F.col("k") % 19).cast("int").alias("z"), M.mercator_x("lon").alias("mx"), M.mercator_y("lat").alias("my"))
    return p.select("k", "z", M.tile_x("z", "mx").alias("x"), M.tile_y("z", "my").alias("y"))


POINT_TILES = f"with {PT_M}, t as (select k, (k % 19)::int z, {clamped(f'floor((mx + {OS}) / {span('(k % 19)')})', '(k % 19)')} x, {clamped(f'floor(({OS} - my) / {span('(k % 19)')})', '(k % 19)')} y from m)"


def tile_bounds(spark, d):
    x0, y0, x1, y1 = M.tile_bounds_m("z", "x", "y")
    return _point_tiles(spark, d).select("k", "z", "x", "y", *[F.round(v, 3).alias(n) for v, n in ((x0, "min_x"), (y0, "min_y"), (x1, "max_x"), (y1, "max_y"))], F.round(M.longitude(x0), 8).alias("west"), F.round(M.latitude(y0), 8).alias("south"))


TILE_BOUNDS = f"""{POINT_TILES}, e as (select k, z, x, y, x * {span('z')} - {OS} x0, {OS} - y * {span('z')} y1, {span('z')} s from t)
select k, z, x, y, round(x0, 3) + 0.0 min_x, round(y1 - s, 3) + 0.0 min_y, round(x0 + s, 3) + 0.0 max_x, round(y1, 3) + 0.0 max_y, round({lon('x0')}, 8) + 0.0 west, round({lat('(y1 - s)')}, 8) + 0.0 south from e"""


def tile_tms_row(spark, d):
    return _point_tiles(spark, d).select("k", "z", "x", "y", M.tms_row("z", "y").alias("tms"))


def tile_range_sql(spark, d):
    """As tile_range_cover, in SQL text: the library's SQL functions, and its table function with LATERAL."""
    from .functions import sql

    sql.register(spark)
    return spark.sql(
        """with m as (select s_suppkey k, mercator_x(lon) x0, mercator_y(lat) y0, mercator_x(lon + w) x1, mercator_y(lat + w) y1
             from (select s_suppkey, ((s_suppkey * 7919) % 34000) / 100D - 175 lon, ((s_suppkey * 104729) % 15000) / 100D - 75 lat, 0.5D + (s_suppkey % 7) w from {supplier}))
           select k, z, min(t.x) x_min, max(t.x) x_max, min(t.y) y_min, max(t.y) y_max, count(*) tiles
           from m, lateral explode(sequence(0, 8)) zooms(z), lateral tiles_for_bounds(z, x0, y0, x1, y1) t group by k, z""",
        supplier=spark.read.parquet(f"{d}/supplier.parquet"))


def tile_range_cover(spark, d):
    b = _boxes_m(spark, d).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(8))))
    x0, x1, y0, y1 = M.tile_range("z", "min_x", "min_y", "max_x", "max_y")
    r = b.select("k", "z", x0.alias("x_min"), x1.alias("x_max"), y0.alias("y_min"), y1.alias("y_max"))
    tiles = r.withColumn("x", F.explode(F.sequence("x_min", "x_max"))).withColumn("y", F.explode(F.sequence("y_min", "y_max")))
    return tiles.groupBy("k", "z", "x_min", "x_max", "y_min", "y_max").agg(F.count(F.lit(1)).alias("tiles"))


TILE_RANGE_COVER = f"with {BOX_M}, r as (select k, z, {range_sql('z', 'x0', 'y0', 'x1', 'y1')} from m, {ZOOMS.format(0, 8)}) select *, (x_max - x_min + 1) * (y_max - y_min + 1) tiles from r"


def zoom_for_resolution(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", M.zoom_for_resolution("p_retailprice").cast("int").alias("zoom"))


ZOOM_FOR_RESOLUTION = f"""select p_partkey, coalesce((select min(z) from {ZOOMS.format(0, 30)} where 2 * {OS} / (256 * pow(2.0::double, z)) <= p_retailprice), 30)::int zoom from part"""


def native_zoom_and_bounds(spark, d):
    meta, _ = views.grid(spark, d)
    w, s, e, n = raster.bounds_m(meta)
    row = (raster.native_zoom(meta), round(raster.native_resolution(meta), 6), round(w, 3), round(s, 3), round(e, 3), round(n, 3))
    return spark.createDataFrame([row], "zoom int, resolution double, min_x double, min_y double, max_x double, max_y double")


NATIVE = f"""with {GRID_META}, q as (select n, {CELL}::double * {OS} / 180 res from meta)
select (select min(z) from {ZOOMS.format(0, 30)} where 2 * {OS} / (256 * pow(2.0::double, z)) <= res)::int zoom, round(res, 6) resolution, round({mx(f'({OX})::double')}, 3) min_x,
 round({my(f'({OY}::double - n * {CELL}::double)')}, 3) min_y, round({mx(f'({OX}::double + {views.COLS} * {CELL}::double)')}, 3) max_x, round({my(f'({OY})::double')}, 3) max_y from q"""


def crs_detect_vector(spark, d):
    degrees = views.point_features(spark, d)
    return vector.detect_crs(degrees.withColumn("layer", F.lit("degrees")).unionByName(vector.to_metres(degrees, "4326").withColumn("layer", F.lit("metres"))))


CRS_DETECT = f"""with {PT_M}, e as (select 'degrees' layer, max(abs(lon)) ax, max(abs(lat)) ay from p union all select 'metres', max(abs(mx)), max(abs(my)) from m)
select layer, case when ax <= 180.5 and ay <= 90.5 then '4326' when ax <= {OS}::double * 1.001::double and ay <= {OS}::double * 1.001::double then '3857' end crs from e"""


def _sample_points(spark, d, meta) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), (meta.origin_x + ((k * 7919) % 13000) / F.lit(100.0) * meta.px_w).alias("x"), (meta.origin_y - ((k * 104729) % (meta.rows * 101)) / F.lit(100.0) * meta.px_h).alias("y"))


SAMPLED = f"""{GRID_META}, s as (select c_custkey k, {OX}::double + ((c_custkey * 7919) % 13000) / 100::double * {CELL}::double x, {OY}::double - ((c_custkey * 104729) % (n * 101)) / 100::double * {CELL}::double y from customer, meta),
q as (select k, (x - ({OX}::double)) / {CELL}::double u, ({OY}::double - y) / {CELL}::double v from s)"""


def sample_nearest(spark, d):
    meta, cells = views.grid(spark, d)
    return raster.sample_points(cells, _sample_points(spark, d, meta), meta, "nearest").select("k", F.round(F.col("value") + AWAY, 6).alias("value"))


SAMPLE_NEAREST = f"with {SAMPLED} select k, round(g.v, 4) as value from q join g on g.c = floor(u)::bigint and g.r = floor(q.v)::bigint where g.v is not null"


def sample_bilinear(spark, d):
    meta, cells = views.grid(spark, d)
    return raster.sample_points(cells, _sample_points(spark, d, meta), meta).select("k", F.round("value", 5).alias("value"))


SAMPLE_BILINEAR = f"""with {SAMPLED}, f as (select k, floor(u - 0.5)::bigint c, floor(v - 0.5)::bigint r, u - 0.5 - floor(u - 0.5) fu, v - 0.5 - floor(v - 0.5) fv from q),
h as (select k, case when g.r = f.r then 1 - fv else fv end * case when g.c = f.c then 1 - fu else fu end w, g.v from f join g on g.r in (f.r, f.r + 1) and g.c in (f.c, f.c + 1) where g.v is not null)
select k, round(sum(w * v) / sum(w), 5) as value from h where w > 0 group by k having sum(w) >= 0.5"""


def area_average(spark, d):
    meta, cells = views.grid(spark, d)
    return raster.area_average(cells, meta, AREA_ZOOM).select("gx", "gy", F.round("value", 6).alias("value"))


def _axis(lo: str, hi: str, z: int) -> str:
    return f"(select unnest(generate_series(({lo}) * 256, (({hi}) + 1) * 256 - 1)) g)"


def _area_sql(z: int, away: float = 0.0) -> str:
    """Brute force: every pixel of the grid's tiles against every cell, by centres."""
    return f"""with {GRID_META}, mb as (select {mx(f'({OX})::double')} x0, {my(f'({OY}::double - n * {CELL}::double)')} y0, {mx(f'({OX}::double + {views.COLS} * {CELL}::double)')} x1, {my(f'({OY})::double')} y1 from meta),
t as (select {range_sql(str(z), 'x0', 'y0', 'x1', 'y1')} from mb),
res as (select 2 * {OS} / (256 * pow(2.0::double, {z})) res, {span(str(z))} sp),
gx as (select unnest(generate_series(x_min * 256, (x_max + 1) * 256 - 1)) g from t), gy as (select unnest(generate_series(y_min * 256, (y_max + 1) * 256 - 1)) g from t),
px as (select g, (floor(g / 256.0) * sp - {OS}) + ((g % 256)::double + 0.5) * res c, res from gx, res), py as (select g, ({OS} - floor(g / 256.0) * sp) - ((g % 256)::double + 0.5) * res c, res from gy, res),
ax as (select g, ({lon('(c - res / 2)')} - ({OX}::double)) / {CELL}::double a, ({lon('(c + res / 2)')} - ({OX}::double)) / {CELL}::double b from px),
ay as (select g, ({OY}::double - {lat('(c - res / 2)')}) / {CELL}::double a, ({OY}::double - {lat('(c + res / 2)')}) / {CELL}::double b from py)
select ax.g gx, ay.g gy, round(avg(v) + {away!r}, 6) as value from g join ax on g.c + 0.5 between least(ax.a, ax.b) and greatest(ax.a, ax.b) join ay on g.r + 0.5 between least(ay.a, ay.b) and greatest(ay.a, ay.b)
where v is not null group by all"""


AREA_AVERAGE = _area_sql(AREA_ZOOM)


def area_pyramid(spark, d):
    """Area means at five zooms from one pass over the cells."""
    meta, cells = views.grid(spark, d)
    return raster.area_pyramid(cells, meta, list(range(AREA_ZOOM - 4, AREA_ZOOM + 1))).select("z", "gx", "gy", F.round(F.col("value") + AWAY, 6).alias("value"))


AREA_PYRAMID = " union all ".join(f"select {z} as z, * from ({_area_sql(z, AWAY)})" for z in range(AREA_ZOOM - 4, AREA_ZOOM + 1))


def tile_stats(spark, d):
    meta, cells = views.grid(spark, d)
    options = PyramidOptions(0, 9)
    pixels = tileset.pixels(cells, meta, options)
    tiles = pixels.select("z", F.floor(F.col("gx") / 256).alias("x"), F.floor(F.col("gy") / 256).alias("y")).distinct()
    return tileset.stats(tiles, meta, options)


def _pixel_tiles_sql(z: int) -> str:
    """Tiles with a bilinear pixel at a zoom."""
    corner = lambda axis, place: f"(select g, k.c, k.w from (select g, floor(m - 0.5)::bigint c0, m - 0.5 - floor(m - 0.5) f from (select g, {place} m from {axis})), lateral (select unnest([c0, c0 + 1]) c, unnest([1 - f, f]) w) k where k.w > 0)"
    return f"""with {GRID_META}, mb as (select {mx(f'({OX})::double')} x0, {my(f'({OY}::double - n * {CELL}::double)')} y0, {mx(f'({OX}::double + {views.COLS} * {CELL}::double)')} x1, {my(f'({OY})::double')} y1 from meta),
t as (select {range_sql(str(z), 'x0', 'y0', 'x1', 'y1')} from mb), res as (select 2 * {OS} / (256 * pow(2.0::double, {z})) res, {span(str(z))} sp),
gx as (select unnest(generate_series(x_min * 256, (x_max + 1) * 256 - 1)) g from t), gy as (select unnest(generate_series(y_min * 256, (y_max + 1) * 256 - 1)) g from t),
px as (select g, (floor(g / 256.0) * sp - {OS}) + ((g % 256)::double + 0.5) * res m from gx, res), py as (select g, ({OS} - floor(g / 256.0) * sp) - ((g % 256)::double + 0.5) * res m from gy, res),
cx as {corner('px', f'({lon("m")} - ({OX}::double)) / {CELL}::double')}, cy as {corner('py', f'({OY}::double - {lat("m")}) / {CELL}::double')},
hit as (select cx.g gx, cy.g gy from g join cx on g.c = cx.c join cy on g.r = cy.c where g.v is not null group by cx.g, cy.g having sum(cx.w * cy.w) >= 0.5)
select distinct floor(gx / 256)::bigint x, floor(gy / 256)::bigint y from hit"""


def _tile_stats_sql() -> str:
    areas = " union all ".join(f"select {z}::int z, count(*) n from (select distinct floor(gx / 256)::bigint x, floor(gy / 256)::bigint y from ({_area_sql(z)}))" for z in range(AREA_ZOOM + 1))
    mb = f"mb as (select {mx(f'({OX})::double')} x0, {my(f'({OY}::double - n * {CELL}::double)')} y0, {mx(f'({OX}::double + {views.COLS} * {CELL}::double)')} x1, {my(f'({OY})::double')} y1 from meta)"
    return f"""with {GRID_META}, {mb}, t as (select z, {range_sql('z', 'x0', 'y0', 'x1', 'y1')} from mb, {ZOOMS.format(0, 9)}),
made as ({areas} union all select 9, count(*) from ({_pixel_tiles_sql(9)})) select t.z, n written, (x_max - x_min + 1) * (y_max - y_min + 1) - n skipped from t join made on t.z = made.z"""


def overview_half(spark, d):
    _, cells = views.grid(spark, d)
    return raster.half(cells).select("row", "col", F.round("value", 6).alias("value"))


OVERVIEW_HALF = f"with g as ({views.GRID}) select floor(r / 2)::bigint as row, floor(c / 2)::bigint as col, round(avg(v), 6) as value from g group by all"


def overview_chain(spark, d):
    emb = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select(F.lit(1).alias("band"), "row", F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("value"))
    rows = emb.agg(F.max("row")).first()[0] + 1
    levels = raster.overviews(emb, rows, 64, 64)
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 5).alias("total"))


def _overview_sql() -> str:
    """As many halvings as the largest test table needs; levels beyond a single tile of 64 are left out."""
    ctes = ["l0 as (select vec_id r, (i - 1)::bigint c, embedding[i]::double v from embeddings, generate_series(1, 64) g(i))"]
    ctes += [f"l{k} as (select floor(r / 2)::bigint r, floor(c / 2)::bigint c, avg(v) v from l{k - 1} group by all)" for k in range(1, 9)]
    parts = [f"select {k} as level, count(*) cells, round(sum(v), 5) total from l{k} having {k} = 0 or (select max(r) + 1 from l{max(k - 1, 0)}) > 64 or (select max(c) + 1 from l{max(k - 1, 0)}) > 64" for k in range(9)]
    return "with " + ", ".join(ctes) + " " + " union all ".join(parts)


def rgb_stretch(spark, d):
    _, cells = views.rgb(spark, d)
    return raster.rgba(cells, ["row", "col"], 4, 10.0, 240.0)


def _byte(b: str) -> str:
    return f"floor(least(greatest(({b}::double - 10) * {1 / 230!r}::double * 255.0::double, 0.0), 255.0))::int"


RGB_STRETCH = f"""with q as ({views.RGB}) select r as row, c as col, coalesce({_byte('b1')}, 0) r, case when b2 is null then 0 else {_byte('b2')} end g, {_byte('b3')} b,
case when b1 is null or b2 is null or b3 is null then 0 else {_byte('b4')} end a from q"""


def auto_stretch(spark, d):
    return raster.auto_stretch(views.grid(spark, d)[1])


def feature_tile_join(spark, d):
    return vector.tiles_of(_boxes_m(spark, d), 0, 6).select("k", "z", "x", "y")


FEATURE_TILE_JOIN = f"""with {BOX_M}, ds as (select min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from m), lim as (select z, {range_sql('z', 'x0', 'y0', 'x1', 'y1')} from ds, {ZOOMS.format(0, 6)}),
t as (select z, x, unnest(generate_series(y_min, y_max)) y from (select *, unnest(generate_series(x_min, x_max)) x from lim)),
r as (select z, x, y, x * {span('z')} - {OS} tx, {OS} - y * {span('z')} ty, {span('z')} s, {span('z')} * (64 / 4096::double) pad from t)
select k, z, x, y from m join r on m.x0 <= tx + s + pad and m.x1 >= tx - pad and m.y0 <= ty + pad and m.y1 >= ty - s - pad"""


def points_in_boxes(spark, d):
    """How many points each box holds, through the quadtree and packed trees. Many points lie on edges but for the last bit."""
    points = _pts(spark, d).select(F.col("k").alias("id"), M.mercator_x("lon").alias("x"), M.northing("lat").alias("y"))
    return spatial_index.points_within(points, _boxes_m(spark, d, M.northing))


#: Every box with every point.
POINTS_IN_BOXES = f"""with p as ({views.PTS}), pm as (select {mx('lon')} mx, {my('lat')} my from p), {BOX_M}
select k, count(*) n from m join pm on mx between x0 and x1 and my between y0 and y1 group by k"""


def dataset_bounds(spark, d):
    f = vector.with_bbox(vector.to_metres(views.box_features(spark, d).unionByName(views.track_features(spark, d)), "4326"))
    return vector.dataset_bounds(f).select(*[F.round(c, 3).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


DATASET_BOUNDS = f"""with b as ({views.BOXES}), t as ({views.TRACKS}), a as (select lon, lat from b union all select lon + w, lat + w from b union all select lon, lat from t)
select round(min({mx('lon')}), 3) min_x, round(min({my('lat')}), 3) min_y, round(max({mx('lon')}), 3) max_x, round(max({my('lat')}), 3) max_y from a"""


def mvt_quantize_points(spark, d):
    q = binned(_pts(spark, d), 0, 5).withColumn("q", vector.quantised(F.struct(F.col("mx").alias("x"), F.col("my").alias("y")), F.col("z"), F.col("x"), F.col("y")))
    return q.select("k", "z", "x", "y", F.col("q.x").alias("qx"), F.col("q.y").alias("qy"))


MVT_QUANTIZE_POINTS = f"""with {PT_M}, t as (select k, mx, my, z, {span('z')} s, {clamped(f'floor((mx + {OS}) / {span('z')})', 'z')} x, {clamped(f'floor(({OS} - my) / {span('z')})', 'z')} y from m, {ZOOMS.format(0, 5)})
select k, z, x, y, round((mx - (x * s - {OS})) * (4096::double / s))::bigint qx, round(({OS} - y * s - my) * (4096::double / s))::bigint qy from t"""


def mvt_quantize_lines(spark, d):
    """Tracks in the world tile and the two zooms below its corner, without clipping."""
    f = vector.to_metres(views.track_features(spark, d), "4326").select(F.col("feature_ord").alias("k"), "kind", "parts").withColumn("z", F.explode(F.array(F.lit(0), F.lit(6), F.lit(12))))
    line = vector.tile_geometry(f.withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")}))
    return line.select("k", "z", F.posexplode(F.get("geom", F.lit(0))).alias("i", "p")).select("k", "z", F.col("i").cast("long").alias("i"), F.col("p.x").alias("qx"), F.col("p.y").alias("qy"))


MVT_QUANTIZE_LINES = f"""with t as ({views.TRACKS}), q as (select k, ord, z, round(({mx('lon')} + {OS}) * (4096::double / {span('z')}))::bigint qx, round(({OS} - {my('lat')}) * (4096::double / {span('z')}))::bigint qy from t, (select unnest([0, 6, 12]) z)),
c as (select *, lag(qx) over w px, lag(qy) over w py from q window w as (partition by k, z order by ord)),
e as (select k, z, ord, qx, qy, count(*) over (partition by k, z) n from c where px is null or px <> qx or py <> qy)
select k, z, row_number() over (partition by k, z order by ord) - 1 i, qx, qy from e where n >= 2"""


def _box_rings(spark, d):
    f = vector.to_metres(views.box_features(spark, d), "4326").select(F.col("feature_ord").alias("k"), "parts").withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(12))))
    ring = F.transform(F.get(F.get("parts", F.lit(0)), F.lit(0)), lambda p: vector.quantised(p, F.col("z"), F.lit(0), F.lit(0)))
    return f.select("k", "z", ring.alias("q")).withColumn("ring", vector.wound_ring(F.col("q"), True))


def mvt_ring_winding(spark, d):
    return _box_rings(spark, d).where("ring is not null").select("k", "z", F.size("ring").cast("long").alias("points"), vector.doubled_area(F.col("ring")).alias("doubled_area"))


_QBOX = f"""{BOX_M}, q as (select k, z, round((x0 + {OS}) * s)::bigint a, round(({OS} - y0) * s)::bigint b, round((x1 + {OS}) * s)::bigint c, round(({OS} - y1) * s)::bigint d from m, (select z, 4096::double / {span('z')} s from {ZOOMS.format(0, 12)}))"""
MVT_RING_WINDING = f"with {_QBOX} select k, z, 4::bigint points, 2 * (c - a) * (b - d) doubled_area from q where (c - a) * (b - d) <> 0"


def degenerate_by_zoom(spark, d):
    return _box_rings(spark, d).groupBy("z").agg(F.count(F.when(F.col("ring").isNull(), 1)).alias("dropped"))


DEGENERATE = f"with {_QBOX} select z, count(*) filter (where (c - a) * (b - d) = 0) dropped from q group by z"


def layer_fields(spark, d):
    return vector.layer_fields(views.view(spark, d, views.PROPS, "events"))


LAYER_FIELDS = f"with p as ({views.PROPS}) select layer, k as key, arg_min(t, ord) as type from p where t is not null group by all"


def feature_ids(spark, d):
    e = F.col("event_id")
    text = F.when(e % 5 == 0, F.concat(F.lit("+"), e.cast("string"))).when(e % 5 == 1, F.concat(F.lit("-"), e.cast("string"))).when(e % 5 == 2, F.concat(e.cast("string"), F.lit(".0"))).when(e % 5 == 3, F.lit("18446744073709551616")).otherwise(e.cast("string"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", vector.feature_id(text).cast("long").alias("id"))


FEATURE_IDS = r"""with t as (select event_id, case event_id % 5 when 0 then '+' || event_id when 1 then '-' || event_id when 2 then event_id || '.0' when 3 then '18446744073709551616' else event_id::varchar end s from events)
select event_id, case when regexp_matches(s, '^\+?[0-9]+$') and try_cast(ltrim(s, '+') as ubigint) is not null then try_cast(ltrim(s, '+') as bigint) end id from t"""


def cog_layout(spark, d):
    meta, _ = views.grid(spark, d)
    rows = [(k, r, c, -(-r // 16) * -(-c // 16)) for k, (r, c) in enumerate(cog.levels_of(meta, 16))]
    return spark.createDataFrame(rows, "level int, rows long, cols long, blocks long")


COG_LAYOUT = f"""with recursive {GRID_META}, l(level, rows, cols) as (select 0, n, {views.COLS}::bigint from meta union all select level + 1, (rows + 1) // 2, (cols + 1) // 2 from l where greatest(rows, cols) > 16)
select level, rows, cols, ((rows + 15) // 16) * ((cols + 15) // 16) blocks from l"""


def mbtiles_metadata(spark, d):
    """What a tileset of the points says of itself."""
    w, so, e, n = _pts(spark, d).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    return spark.createDataFrame(tileset.metadata_rows("points", "pbf", (w, so, e, n), 3, 11), "name string, value string")


_NUMBER = "regexp_replace(({})::varchar, '[.]0$', '')"
MBTILES_METADATA = f"""with p as ({views.PTS}), b as (select min(lon) w, min(lat) s, max(lon) e, max(lat) n from p)
select name, value from b, lateral (select unnest(['name', 'format', 'bounds', 'center', 'minzoom', 'maxzoom', 'type', 'version', 'description']) as name,
unnest(['points', 'pbf', {" || ',' || ".join(_NUMBER.format(v) for v in "wsen")}, {_NUMBER.format('(w + e) / 2')} || ',' || {_NUMBER.format('(s + n) / 2')} || ',3', '3', '11', 'overlay', '1', 'points']) as value) t"""


def tile_lookup(spark, d):
    from .sources.readers import lookup

    return lookup(tile_point_counts(spark, d), 2, 1, 1).select("z", "x", "y", "n")


def tile_windows(spark, d):
    """Points of events per hour and tile, as the streaming form computes them."""
    from .streaming.tiles import windowed_counts

    e = F.col("event_id")
    points = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (((e * 7919) % 20000) / F.lit(10000.0) - 72).alias("lon"), (((e * 104729) % 20000) / F.lit(10000.0) - 34).alias("lat"))
    return windowed_counts(points, 8, 8, "1 hour", "2 hours").groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("hours"), F.sum("n").alias("n"))


TILE_WINDOWS = f"""with t as (select ts, event_id, ((event_id*7919)%20000)/10000::double-72 lon, ((event_id*104729)%20000)/10000::double-34 lat from events),
q as (select date_trunc('hour', ts) h, 8 z, floor(({mx('lon')} + {OS}) / {span('8')})::bigint x, floor(({OS} - {my('lat')}) / {span('8')})::bigint y from t)
select z, x, y, count(distinct h) as hours, count(*)::bigint n from q group by all"""


def _features(spark, d) -> DataFrame:
    return vector.to_metres(views.point_features(spark, d).unionByName(views.box_features(spark, d)).unionByName(views.track_features(spark, d)), "4326")


def png_tiles(spark, d):
    meta, cells = views.grid(spark, d)
    return tileset.raster_tileset(cells, meta, PyramidOptions(0, 10)).select("z", "x", "y", F.octet_length("data").alias("bytes"))


def webp_tiles(spark, d):
    meta, cells = views.rgb(spark, d)
    return tileset.raster_tileset(cells, meta, PyramidOptions(8, 9, format="webp")).select("z", "x", "y", F.octet_length("data").alias("bytes"))


def mvt_tiles(spark, d):
    return tileset.vector_tileset(_features(spark, d), MvtOptions(0, 6)).select("z", "x", "y", F.octet_length("data").alias("bytes"))


def _clipped(spark, d, kind: str, options: MvtOptions):
    rows = tileset.feature_tiles(_features(spark, d).where(F.col("kind") == kind), options)
    return rows.select("layer", "feature_ord", "z", "x", "y", F.size("geom").alias("parts"), F.size(F.flatten("geom")).alias("points"))


def mvt_clipped_lines(spark, d):
    return _clipped(spark, d, "LineString", MvtOptions(6, 8))


def mvt_clipped_polygons(spark, d):
    return _clipped(spark, d, "Polygon", MvtOptions(0, 5))


#: A box meets a tile in a rectangle, so a ring of four points is left unless a side rounds to nothing.
_QUANTISED = ("round((greatest(m.x0, tx - pad) - tx) * (4096 / s))", "round((least(m.x1, tx + s + pad) - tx) * (4096 / s))", "round((ty - least(m.y1, ty + pad)) * (4096 / s))", "round((ty - greatest(m.y0, ty - s - pad)) * (4096 / s))")
MVT_CLIPPED_POLYGONS = f"""with {BOX_M}, ds as (select min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from m), lim as (select z, {range_sql('z', 'x0', 'y0', 'x1', 'y1')} from ds, {ZOOMS.format(0, 5)}),
t as (select z, x, unnest(generate_series(y_min, y_max)) y from (select *, unnest(generate_series(x_min, x_max)) x from lim)),
r as (select z, x, y, x * {span('z')} - {OS} tx, {OS} - y * {span('z')} ty, {span('z')} s, {span('z')} * (64 / 4096::double) pad from t),
q as (select k, z, x, y, {', '.join(f'{v} q{i}' for i, v in enumerate(_QUANTISED))} from m join r on m.x0 < tx + s + pad and m.x1 > tx - pad and m.y0 < ty + pad and m.y1 > ty - s - pad)
select 'boxes' layer, k feature_ord, z, x, y, 1::int parts, 4::int points from q where q0 < q1 and q2 < q3"""
MVT_DECODED_BOXES = MVT_CLIPPED_POLYGONS.replace("select 'boxes' layer, k feature_ord, z, x, y, 1::int parts, 4::int points", "select z, x, y, k, 1::int rings, q0::bigint q0, q1::bigint q1, q2::bigint q2, q3::bigint q3")


def cog_blocks(spark, d):
    meta, cells = views.grid(spark, d)
    return cog.blocks(cells, meta, CogOptions(64)).select("level", "block_row", "block_col", F.octet_length("data").alias("bytes"))


def mvt_decoded_points(spark, d):
    """Points from finished tiles: cut, encoded in part, merged, gzipped and decoded again."""
    tiles = tileset.vector_tileset(vector.to_metres(views.point_features(spark, d), "4326"), MvtOptions(0, 5))
    return tileset.decoded(tiles).select("z", "x", "y", "layer", F.col("id").cast("long").alias("k"), F.explode(F.flatten("geom")).alias("p"), F.element_at("props", "k").cast("long").alias("prop")).select("z", "x", "y", "layer", "k", "prop", F.col("p.x").alias("qx"), F.col("p.y").alias("qy"))


MVT_DECODED_POINTS = f"""with {PT_M}, ds as (select min(mx) x0, min(my) y0, max(mx) x1, max(my) y1 from m), lim as (select z, {range_sql('z', 'x0', 'y0', 'x1', 'y1')} from ds, {ZOOMS.format(0, 5)}),
t as (select z, x, unnest(generate_series(y_min, y_max)) y from (select *, unnest(generate_series(x_min, x_max)) x from lim)),
r as (select z, x, y, x * {span('z')} - {OS} tx, {OS} - y * {span('z')} ty, {span('z')} s, {span('z')} * (64 / 4096::double) pad from t)
select z, x, y, 'pts' layer, k, k prop, round((mx - tx) * (4096::double / s))::bigint qx, round((ty - my) * (4096::double / s))::bigint qy
from m join r on mx between tx - pad and tx + s + pad and my between ty - s - pad and ty + pad"""


def mvt_decoded_boxes(spark, d):
    """The rectangles that finished tiles show of boxes."""
    tiles = tileset.vector_tileset(vector.to_metres(views.box_features(spark, d), "4326"), MvtOptions(0, 5))
    xs, ys = F.transform(F.flatten("geom"), lambda p: p.x), F.transform(F.flatten("geom"), lambda p: p.y)
    return tileset.decoded(tiles).select("z", "x", "y", F.col("id").cast("long").alias("k"), F.size("geom").alias("rings"), F.array_min(xs).alias("q0"), F.array_max(xs).alias("q1"), F.array_min(ys).alias("q2"), F.array_max(ys).alias("q3"))


def _written_grid(spark, d) -> str:
    """The grid view as a tiled GeoTIFF in the shared folder."""
    meta, cells = views.grid(spark, d)
    path = f"{shared_path(spark)}/grid.tif"
    cog.write_cog(cells, meta, path, CogOptions(64))
    return path


def geotiff_scan(spark, d):
    """The grid, written as a tiled GeoTIFF and read back by block: every cell of the file."""
    return geotiff.scan(spark, _written_grid(spark, d))[1].select("row", "col", "value")


#: A band of a GeoTIFF holds 32-bit floats; cells that no order has are missing.
GEOTIFF_SCAN = f"""with {GRID_META}, every as (select r as row, c as col from meta, generate_series(0, n - 1) a(r), generate_series(0, {views.COLS - 1}) b(c))
select e.row, e.col, g.v::float::double as value from every e left join g on g.r = e.row and g.c = e.col"""


def geotiff_window(spark, d):
    """A window of it, of which only its own blocks are read."""
    return geotiff.scan(spark, _written_grid(spark, d))[1].where("row between 10 and 90 and col >= 70").select("row", "col", "value")


def geojson_scan(spark, d):
    """Points written as one line of GeoJSON and read back by range: a vertex and a property a row."""
    path = f"{shared_path(spark)}/points.geojson"
    files.write_geojson(views.point_features(spark, d).unionByName(views.box_features(spark, d)), path)
    found = geojson.scan(spark, path, "all", range_bytes=1 << 16).select(F.col("id").cast("long").alias("k"), "kind", F.posexplode(F.flatten(F.flatten("parts"))).alias("i", "p"), F.get("props", F.lit(0)).alias("v"))
    return found.select("k", "kind", "i", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"), F.col("v.k").alias("key"), F.col("v.t").alias("type"), F.col("v.i").alias("number"))


GEOJSON_SCAN = f"""with p as ({views.PTS}), b as ({views.BOXES}), every as (select k, 'Point' kind, 0 i, lon x, lat y from p union all
select k, 'Polygon', i, lon + dx * w, lat + dy * w from b, (select unnest([0, 1, 2, 3, 4]) i, unnest([0, 1, 1, 0, 0]) dx, unnest([0, 0, 1, 1, 0]) dy))
select k, kind, i::int i, round(x, 9) + 0.0 x, round(y, 9) + 0.0 y, 'k' as key, 'Int' as type, k as number from every"""


def shapefile_scan(spark, d):
    """Points and boxes written as shapefiles and read back by ranges of records."""
    root, found = shared_path(spark), None
    for name, layer in (("points", views.point_features(spark, d)), ("boxes", views.box_features(spark, d))):
        shapefiles.write_shapefile(layer, f"{root}/{name}.shp")
        rows = shapefile.scan(spark, f"{root}/{name}.shp", name, rows=500)
        found = rows if found is None else found.unionByName(rows)
    vertex = found.select("kind", F.get("props", F.lit(0)).alias("v"), F.posexplode(F.flatten(F.flatten("parts"))).alias("i", "p"))
    return vertex.select(F.col("v.i").alias("k"), "kind", "i", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"), F.col("v.k").alias("key"), F.col("v.t").alias("type"))


# outer rings run clockwise in the file
SHAPEFILE_SCAN = f"""with p as ({views.PTS}), b as ({views.BOXES}), every as (select k, 'Point' kind, 0 i, lon x, lat y from p union all
select k, 'Polygon', i, lon + dx * w, lat + dy * w from b, (select unnest([0, 1, 2, 3, 4]) i, unnest([0, 0, 1, 1, 0]) dx, unnest([0, 1, 1, 0, 0]) dy))
select k, kind, i::int i, round(x, 9) + 0.0 x, round(y, 9) + 0.0 y, 'k' as key, 'Int' as type from every"""


def _count_tiles(spark, d):
    """Tiles that hold the number of their points, as text."""
    return tile_point_counts(spark, d).select(F.col("z").cast("int").alias("z"), "x", "y", F.encode(F.col("n").cast("string"), "utf-8").alias("data"))


def xyz_files(spark, d):
    """Tiles written as a tree of files and read back."""
    root = f"{shared_path(spark)}/xyz"
    xyz.write_xyz(_count_tiles(spark, d), root, "txt", tileset.metadata_rows("counts", "txt", (-180.0, -85.0, 180.0, 85.0), 0, 6))
    return xyz.read_xyz(spark, root)[1].select("z", "x", "y", F.decode("data", "utf-8").cast("long").alias("n"))


REQUESTS = """select c_custkey k, case c_custkey % 9 when 0 then 'counts/2/1/north' when 1 then 'else/1/0/0.png' when 2 then '../1/0/0' when 3 then 'counts/3' when 4 then 'counts/7/1/1'
else 'counts/' || cast(c_custkey % 7 as string) || '/' || cast((c_custkey * 31) % (1 << cast(c_custkey % 7 as int)) as string) || '/' || cast((c_custkey * 17) % (1 << cast(c_custkey % 7 as int)) as string) || case when c_custkey % 2 = 0 then '.pbf' else '' end end path from customer"""


def tile_requests(spark, d):
    """A batch of requests, good and bad, answered from an index of tiles."""
    path = shared_folder(spark)
    tile_index.write_index(_count_tiles(spark, d), path)
    asked = tile_index.parsed_requests(views.view(spark, d, REQUESTS, "customer"))
    got = tile_index.served({"counts": ("pbf", spark.read.parquet(path))}, asked)
    return got.select("k", "path", "status", "content_type", "encoding", F.decode("data", "utf-8").cast("long").alias("n"))


def _tile_requests_sql() -> str:
    whole = lambda v: f"case when regexp_matches({v}, '^[0-9]+$') then {v}::bigint end"
    return f"""with asked as ({REQUESTS.replace("<< cast(c_custkey % 7 as int)", "<< (c_custkey % 7)::int")}), parts as (select k, path, string_split(path, '/') p from asked),
named as (select k, path, p[1] layer, {whole('p[2]')} z, {whole('p[3]')} x, {whole("string_split(p[4], '.')[1]")} y from parts), tiles as ({TILE_POINT_COUNTS}),
told as (select k, path, case when a.z is null or a.x is null or a.y is null then 400 when layer <> 'counts' then 404 when n is null then 204 else 200 end::int status, n from named a left join tiles t on layer = 'counts' and a.z = t.z and a.x = t.x and a.y = t.y)
select k, path, status, case when status = 200 then 'application/x-protobuf' end content_type, case when status = 200 then 'gzip' end as encoding, case when status = 200 then n end n from told"""


def vector_catalogue(spark, d):
    text = tileset.vector_layers_json(_features(spark, d), MvtOptions())
    return spark.createDataFrame([(text,)], "json string")


VECTOR_CATALOGUE = """with l as (select 'pts' id, 0 o, count(*) n from customer union all select 'boxes', 1, count(*) from supplier union all select 'tracks', 2, count(*) from events)
select '{"vector_layers": [' || string_agg('{"id": "' || id || '", "minzoom": 0, "maxzoom": 14, "fields": {"k": "Number"}}', ', ' order by o) || ']}' json from l where n > 0"""


def queries() -> dict:
    names = (tile_point_counts, mercator_forward, mercator_inverse, tile_bounds, tile_tms_row, tile_range_cover, tile_range_sql, zoom_for_resolution, native_zoom_and_bounds, crs_detect_vector,
             sample_nearest, sample_bilinear, area_average, area_pyramid, tile_stats, overview_half, overview_chain, rgb_stretch, auto_stretch, feature_tile_join, points_in_boxes, dataset_bounds, mvt_quantize_points,
             mvt_quantize_lines, mvt_ring_winding, degenerate_by_zoom, layer_fields, feature_ids, cog_layout, mbtiles_metadata, tile_lookup, tile_windows, png_tiles, webp_tiles, mvt_tiles,
             mvt_clipped_lines, mvt_clipped_polygons, cog_blocks, vector_catalogue, geotiff_scan, geotiff_window, geojson_scan, shapefile_scan, xyz_files, tile_requests, mvt_decoded_points, mvt_decoded_boxes)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {
        "tile_point_counts": TILE_POINT_COUNTS,
        "mercator_forward": f"with {PT_M} select k, round(mx, 3) mx, round(my, 3) my from m",
        "mercator_inverse": f"with {PT_M} select k, round({lon('mx')}, 8) lon, round({lat('my')}, 8) lat from m",
        "tile_bounds": TILE_BOUNDS,
        "tile_tms_row": f"{POINT_TILES} select k, z, x, y, (pow(2, z) - 1)::bigint - y tms from t",
        "tile_range_sql": TILE_RANGE_COVER,
        "vector_catalogue": VECTOR_CATALOGUE,
        "tile_range_cover": TILE_RANGE_COVER,
        "zoom_for_resolution": ZOOM_FOR_RESOLUTION,
        "native_zoom_and_bounds": NATIVE,
        "crs_detect_vector": CRS_DETECT,
        "sample_nearest": SAMPLE_NEAREST,
        "sample_bilinear": SAMPLE_BILINEAR,
        "area_average": AREA_AVERAGE,
        "area_pyramid": AREA_PYRAMID,
        "tile_stats": _tile_stats_sql(),
        "overview_half": OVERVIEW_HALF,
        "overview_chain": _overview_sql(),
        "rgb_stretch": RGB_STRETCH,
        "auto_stretch": f"with g as ({views.GRID}) select min(v) lo, max(v) hi from g",
        "feature_tile_join": FEATURE_TILE_JOIN,
        "points_in_boxes": POINTS_IN_BOXES,
        "dataset_bounds": DATASET_BOUNDS,
        "mvt_quantize_points": MVT_QUANTIZE_POINTS,
        "mvt_quantize_lines": MVT_QUANTIZE_LINES,
        "mvt_ring_winding": MVT_RING_WINDING,
        "mvt_clipped_polygons": MVT_CLIPPED_POLYGONS,
        "degenerate_by_zoom": DEGENERATE,
        "layer_fields": LAYER_FIELDS,
        "feature_ids": FEATURE_IDS,
        "cog_layout": COG_LAYOUT,
        "mbtiles_metadata": MBTILES_METADATA,
        "tile_lookup": f"select * from ({TILE_POINT_COUNTS}) where z = 2 and x = 1 and y = 1",
        "tile_windows": TILE_WINDOWS,
        "mvt_decoded_points": MVT_DECODED_POINTS,
        "mvt_decoded_boxes": MVT_DECODED_BOXES,
        "xyz_files": TILE_POINT_COUNTS,
        "tile_requests": _tile_requests_sql(),
        "geojson_scan": GEOJSON_SCAN,
        "shapefile_scan": SHAPEFILE_SCAN,
        "geotiff_scan": GEOTIFF_SCAN,
        "geotiff_window": f"select * from ({GEOTIFF_SCAN}) where row between 10 and 90 and col >= 70",
    }
