"""Raster operators over cells: ``cells(band, row, col, value)``, a null value where data are missing.

Pixels have global numbers ``gx = x * tile_size + j`` and ``gy = y * tile_size + i``. A pixel is an
axis-aligned rectangle in both reference systems, so what it needs of the grid's columns depends on
gx alone, and of its rows on gy alone: two small one-dimensional maps, joined to the cells by
equality, replace a join of pixels with cells.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..plans.options import RasterMeta, TileError

#: Least weight of valid cells in a bilinear sample, and pixel-to-cell ratio above which areas are averaged.
LEAST_WEIGHT = 0.5
AREA_FACTOR = 2.0
#: A map is broadcast up to this many rows.
MAP_ROWS = 1_000_000
#: Cells or pixels that a task adds up, beyond which more tasks are made than there are shuffle partitions.
TASK_ROWS = 1_200_000


def dealt(rows: DataFrame, n: int, *keys) -> DataFrame:
    """``n`` rows at most, by the keys that they are grouped by next: as they are while the shuffle's own partitions do,
    else dealt out to tasks of TASK_ROWS, so that a task's memory doesn't grow with the table. Not for keys of many rows."""
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def in_blocks(cells: DataFrame, meta: RasterMeta) -> DataFrame:
    """Valid cells; those of a large grid are dealt out in blocks (_r, _c) of neighbours, several a task, see ``summed``."""
    valid = cells.where("value is not null")
    blocks = valid.withColumns({"_r": F.floor(F.col("row") / max(1, TASK_ROWS // 8 // (meta.cols * meta.bands))), "_c": F.floor(F.col("col") / TASK_ROWS)})
    apart = dealt(blocks, meta.rows * meta.cols * meta.bands, "_r", "_c")
    return valid if apart is blocks else apart


def summed(hits: DataFrame, size: int, keys: tuple[str, ...], **values: Column) -> DataFrame:
    """Sums of the values by keys, of which there are ``size`` at most. Cells in blocks are first added up within each, which
    leaves a key a few sums, however many cells it has."""
    if "_r" in hits.columns:
        hits = dealt(hits.groupBy("_r", "_c", *keys).agg(*[F.sum(v).alias(k) for k, v in values.items()]), size, *keys)
        values = {k: F.col(k) for k in values}
    return hits.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in values.items()])


def normalised(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """NaN and nodata become null, once, at the scan."""
    missing = F.isnan("value")
    if nodata is not None:
        missing = missing | (F.col("value") == nodata)
    return cells.withColumn("value", F.when(~missing, F.col("value")))


def detect_crs(meta_bounds: tuple[float, float, float, float], epsg: int | None = None, override: str | None = None) -> str:
    """Override, then EPSG code, then what the bounds allow."""
    if override or epsg:
        crs = override or {4326: "4326", 3857: "3857", 900913: "3857"}.get(epsg)
        if crs not in ("4326", "3857"):
            raise TileError(f"unsupported CRS {override or epsg}")
        return crs
    w, s, e, n = meta_bounds
    if max(abs(w), abs(e)) <= 180.5 and max(abs(s), abs(n)) <= 90.5:
        return "4326"
    if max(abs(w), abs(e)) <= M.ORIGIN_SHIFT_M * 1.001 and e - w > 360:
        return "3857"
    raise TileError("the CRS can't be told from the bounds")


def bounds_m(meta: RasterMeta) -> tuple[float, float, float, float]:
    """Bounds in metres; degrees are clamped to what the projection holds."""
    w, s, e, n = meta.bounds
    if meta.crs == "3857":
        return w, s, e, n
    x = lambda lon: math.radians(min(max(lon, -180.0), 180.0)) * M.EARTH_RADIUS_M
    y = lambda lat: math.log(math.tan(math.pi / 4 + math.radians(min(max(lat, -M.MAX_LATITUDE_DEG), M.MAX_LATITUDE_DEG)) / 2)) * M.EARTH_RADIUS_M
    return x(w), y(s), x(e), y(n)


def bounds_degrees(meta: RasterMeta) -> tuple[float, float, float, float]:
    """Bounds in degrees, as metadata has them: those of a grid in degrees as they are, others turned back from metres."""
    w, s, e, n = meta.bounds
    if meta.crs == "4326":
        return w, s, e, n
    lon = lambda x: math.degrees(x / M.EARTH_RADIUS_M)
    lat = lambda y: math.degrees(2 * math.atan(math.exp(y / M.EARTH_RADIUS_M)) - math.pi / 2)
    return lon(w), lat(s), lon(e), lat(n)


def native_resolution(meta: RasterMeta) -> float:
    return meta.px_w if meta.crs == "3857" else meta.px_w * M.ORIGIN_SHIFT_M / 180.0


def native_zoom(meta: RasterMeta, tile_size: int = M.TILE_SIZE) -> int:
    own = native_resolution(meta)
    return next((z for z in range(M.MAX_ZOOM) if 2 * M.ORIGIN_SHIFT_M / (tile_size * 2.0**z) <= own), M.MAX_ZOOM)


def uses_area(meta: RasterMeta, z: int, tile_size: int = M.TILE_SIZE) -> bool:
    """Decided per zoom, whatever resampling is asked for."""
    return 2 * M.ORIGIN_SHIFT_M / (tile_size * 2.0**z) > AREA_FACTOR * native_resolution(meta)


def tile_extent(meta: RasterMeta, z: int) -> tuple[int, int, int, int]:
    """(x_min, x_max, y_min, y_max) of the tiles that the grid touches."""
    w, s, e, n = bounds_m(meta)
    span, last = 2 * M.ORIGIN_SHIFT_M / 2.0**z, 2**z - 1
    eps = span * 1e-9
    tile = lambda v: min(max(math.floor(v / span), 0), last)
    x0, y0 = tile(w + M.ORIGIN_SHIFT_M), tile(M.ORIGIN_SHIFT_M - n)
    return x0, max(x0, tile(e - eps + M.ORIGIN_SHIFT_M)), y0, max(y0, tile(M.ORIGIN_SHIFT_M - (s + eps)))


def axis_map(spark: SparkSession, meta: RasterMeta, z: int, axis: str, tile_size: int = M.TILE_SIZE) -> DataFrame:
    """(g, a, b, mid) for each pixel column ('x') or row ('y') of the grid's tiles: where its two edges and
    its centre fall, in cells from the origin."""
    x0, x1, y0, y1 = tile_extent(meta, z)
    lo, hi = (x0, x1) if axis == "x" else (y0, y1)
    span, res = 2 * M.ORIGIN_SHIFT_M / 2.0**z, 2 * M.ORIGIN_SHIFT_M / (tile_size * 2.0**z)
    g = spark.range(lo * tile_size, (hi + 1) * tile_size).select(F.col("id").alias("g"))
    tile, pixel = F.floor(F.col("g") / tile_size), (F.col("g") % tile_size).cast("double")
    if axis == "x":
        centre = (tile * F.lit(span) - M.ORIGIN_SHIFT_M) + (pixel + 0.5) * F.lit(res)
        place = lambda m: ((M.longitude(m) if meta.crs == "4326" else m) - F.lit(meta.origin_x)) / F.lit(meta.px_w)
    else:
        centre = (F.lit(M.ORIGIN_SHIFT_M) - tile * F.lit(span)) - (pixel + 0.5) * F.lit(res)
        place = lambda m: (F.lit(meta.origin_y) - (M.latitude(m) if meta.crs == "4326" else m)) / F.lit(meta.px_h)
    return g.select("g", place(centre - F.lit(res / 2)).alias("a"), place(centre + F.lit(res / 2)).alias("b"), place(centre).alias("mid"))


def counted(axis: DataFrame) -> DataFrame:
    """A map of an axis, to be broadcast if it is counted to be small; it is made of numbers, not of cells."""
    return F.broadcast(axis) if axis.limit(MAP_ROWS + 1).count() <= MAP_ROWS else axis


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAP_ROWS else df


def covered_cells(axis: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """((g, cell) of cells whose centre the pixel holds, g of pixels that hold no centre at all)."""
    first, last = F.ceil(F.least("a", "b") - 0.5), F.floor(F.greatest("a", "b") - 0.5)
    ranged = axis.select("g", first.alias("first"), last.alias("last"))
    inside = ranged.where("first <= last").select("g", F.greatest("first", F.lit(0)).alias("lo"), F.least("last", F.lit(size - 1)).alias("hi")).where("lo <= hi")
    return inside.select("g", F.explode(F.sequence("lo", "hi")).alias("cell")), ranged.where("first > last").select("g")


def thin_pixels(meta: RasterMeta, z: int, tile_size: int = M.TILE_SIZE) -> bool:
    """Whether a pixel near the grid may be narrower than a cell: told from the widths at the grid's edges,
    as pixels shrink with latitude alone. Wider ones always hold a centre."""
    res = 2 * M.ORIGIN_SHIFT_M / (tile_size * 2.0**z)
    if meta.crs == "3857":
        return res < meta.px_w or res < meta.px_h
    _, s, _, n = bounds_m(meta)
    lat = lambda m: math.degrees(2 * math.atan(math.exp(m / M.EARTH_RADIUS_M)) - math.pi / 2)
    high = min(lat(m + res) - lat(m) for m in (s - 2 * res, n + res))
    return math.degrees(res / M.EARTH_RADIUS_M) < meta.px_w * (1 + 1e-9) or high < meta.px_h * (1 + 1e-9)


def area_average(cells: DataFrame, meta: RasterMeta, z: int, tile_size: int = M.TILE_SIZE) -> DataFrame:
    """(band, gx, gy, value): the mean of the valid cells whose centres a pixel holds; bilinear at the
    centre for pixels that hold no centre on one of the axes. Pixels without a value are left out."""
    spark = cells.sparkSession
    xs, ys = (axis_map(spark, meta, z, a, tile_size) for a in "xy")
    cols, thin_x = covered_cells(xs, meta.cols)
    rows, thin_y = covered_cells(ys, meta.rows)
    x0, x1, y0, y1 = tile_extent(meta, z)
    n_x, n_y = max(meta.cols, (x1 - x0 + 1) * tile_size), max(meta.rows, (y1 - y0 + 1) * tile_size)
    hits = (
        in_blocks(cells, meta)
        .join(_small(cols.select(F.col("g").alias("gx"), F.col("cell").alias("col")), n_x), "col")
        .join(_small(rows.select(F.col("g").alias("gy"), F.col("cell").alias("row")), n_y), "row")
    )
    mean = summed(hits, meta.rows * meta.cols * meta.bands, ("band", "gx", "gy"), s=F.col("value"), n=F.lit(1)).select("band", "gx", "gy", (F.col("s") / F.col("n")).alias("value"))
    if not thin_pixels(meta, z, tile_size):
        return mean
    # pixels thin on x with any row, and pixels thin on y with columns that are not: each once
    near = lambda axis, size: axis.where((F.col("mid") > -1) & (F.col("mid") < size + 1))
    near_x, near_y = near(xs, meta.cols), near(ys, meta.rows)
    fallback = bilinear(cells, near_x.join(thin_x, "g", "left_semi"), near_y, meta).unionByName(
        bilinear(cells, near_x.join(thin_x, "g", "left_anti"), near_y.join(thin_y, "g", "left_semi"), meta))
    return mean.unionByName(fallback)


def rolled_zooms(meta: RasterMeta, zooms: list[int], spark: SparkSession, tile_size: int = M.TILE_SIZE) -> list[int]:
    """Of ``zooms``, those whose area means follow from the deepest one's sums: every cell centre falls in the
    pixel above its pixel at the deepest zoom, on both axes. A centre on an edge belongs to the pixels on both
    sides, which only the edges of its own zoom tell; and pixels narrower than a cell have no sums. Both are
    told from the axes alone, so this reads no cell."""
    deepest = max(zooms)
    others = [z for z in zooms if z != deepest and not thin_pixels(meta, z, tile_size)]
    if not others or thin_pixels(meta, deepest, tile_size):
        return []
    checks = None
    for axis, size in (("x", meta.cols), ("y", meta.rows)):
        deep = covered_cells(axis_map(spark, meta, deepest, axis, tile_size), size)[0]
        for z in others:
            own = covered_cells(axis_map(spark, meta, z, axis, tile_size), size)[0]
            above = deep.select(F.shiftright("g", deepest - z).alias("g"), "cell")
            both = own.select("g", "cell", F.lit(1).alias("n")).unionByName(above.select("g", "cell", F.lit(-1).alias("n"))).select(F.lit(axis).alias("axis"), F.lit(z).alias("z"), "*")
            checks = both if checks is None else checks.unionByName(both)
    wrong = checks.groupBy("axis", "z", "g", "cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).where("n <> 0 or m <> 2").select("z").distinct()
    bad = {r["z"] for r in wrong.collect()}
    return [z for z in others if z not in bad]


def area_sums(cells: DataFrame, meta: RasterMeta, z: int, tile_size: int = M.TILE_SIZE) -> DataFrame:
    """(band, gx, gy, s, n): sum and number of the valid cells whose centres a pixel holds."""
    xs, ys = (axis_map(cells.sparkSession, meta, z, a, tile_size) for a in "xy")
    x0, x1, y0, y1 = tile_extent(meta, z)
    n_x, n_y = max(meta.cols, (x1 - x0 + 1) * tile_size), max(meta.rows, (y1 - y0 + 1) * tile_size)
    hits = (
        in_blocks(cells, meta)
        .join(_small(covered_cells(xs, meta.cols)[0].select(F.col("g").alias("gx"), F.col("cell").alias("col")), n_x), "col")
        .join(_small(covered_cells(ys, meta.rows)[0].select(F.col("g").alias("gy"), F.col("cell").alias("row")), n_y), "row")
    )
    return summed(hits, meta.rows * meta.cols * meta.bands, ("band", "gx", "gy"), s=F.col("value"), n=F.lit(1))


def area_pyramid(cells: DataFrame, meta: RasterMeta, zooms: list[int], tile_size: int = M.TILE_SIZE) -> DataFrame:
    """(z, band, gx, gy, value): area means at several zooms. Cells are read and added up once, for the deepest
    zoom; sums and numbers of four pixels make those of the pixel above, zoom by zoom, each from the shuffle
    of the one below. Zooms that can't be had so (``rolled_zooms``) are averaged from the cells."""
    rolled = rolled_zooms(meta, zooms, cells.sparkSession, tile_size)
    parts = [area_average(cells, meta, z, tile_size).withColumn("z", F.lit(z)) for z in zooms if z not in rolled and (z != max(zooms) or not rolled)]
    if rolled:
        at, sums = max(zooms), area_sums(cells, meta, max(zooms), tile_size)
        size = meta.rows * meta.cols * meta.bands  # a pixel holds a cell at least
        for z in [at, *sorted(rolled, reverse=True)]:
            if z != at:
                up = at - z
                above = sums.select("band", F.shiftright("gx", up).alias("gx"), F.shiftright("gy", up).alias("gy"), "s", "n")
                sums = dealt(above, size, "band", "gx", "gy").groupBy("band", "gx", "gy").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
                at, size = z, size >> 2 * up
            parts.append(sums.select("band", "gx", "gy", (F.col("s") / F.col("n")).alias("value"), F.lit(z).alias("z")))
    return reduce(DataFrame.unionByName, parts)


def nearest(cells: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """(band, gx, gy, value): the cell that holds the pixel's centre."""
    at = lambda axis, g, cell: counted(axis.select(F.col("g").alias(g), F.floor("mid").alias(cell)))
    return cells.where("value is not null").join(at(xs, "gx", "col"), "col").join(at(ys, "gy", "row"), "row").select("band", "gx", "gy", "value")


def corners(axis: DataFrame, g: str, cell: str, weight: str) -> DataFrame:
    """The two cells next to each centre on an axis, with their weights; zero weights are left out."""
    low = F.floor(F.col("mid") - 0.5)
    share = F.col("mid") - 0.5 - low
    return axis.select(F.col("g").alias(g), F.explode(F.array(F.struct(low.alias("c"), (1 - share).alias("w")), F.struct((low + 1).alias("c"), share.alias("w")))).alias("k")).where("k.w > 0").select(g, F.col("k.c").alias(cell), F.col("k.w").alias(weight))


def weighted(hits: DataFrame, *keys: str, size: int = 0) -> DataFrame:
    """Means by weight, where valid cells hold LEAST_WEIGHT at least; ``size``: how many there may be."""
    return summed(hits, size, keys, sw=F.col("w"), sv=F.col("w") * F.col("value")).where(F.col("sw") >= LEAST_WEIGHT).select(*keys, (F.col("sv") / F.col("sw")).alias("value"))


def bilinear(cells: DataFrame, xs: DataFrame, ys: DataFrame, meta: RasterMeta) -> DataFrame:
    """(band, gx, gy, value) at the pixels' centres."""
    hits = in_blocks(cells, meta).join(counted(corners(xs, "gx", "col", "wx")), "col").join(counted(corners(ys, "gy", "row", "wy")), "row").withColumn("w", F.col("wx") * F.col("wy"))
    return weighted(hits, "band", "gx", "gy", size=4 * meta.rows * meta.cols * meta.bands)


def sample_points(cells: DataFrame, points: DataFrame, meta: RasterMeta, method: str = "bilinear") -> DataFrame:
    """(k, band, value) for points (k, x, y) in the grid's reference system; points without a value are left out."""
    px = points.where("not isnan(x) and not isnan(y) and abs(x) < double('Infinity') and abs(y) < double('Infinity')").select("k", ((F.col("x") - meta.origin_x) / meta.px_w).alias("u"), ((F.lit(meta.origin_y) - F.col("y")) / meta.px_h).alias("v"))
    valid = cells.where("value is not null")
    if method == "nearest":
        return px.select("k", F.floor("u").alias("col"), F.floor("v").alias("row")).join(valid, ["row", "col"]).select("k", "band", "value")
    c, r = F.floor(F.col("u") - 0.5), F.floor(F.col("v") - 0.5)
    fu, fv = F.col("u") - 0.5 - c, F.col("v") - 0.5 - r
    corner = lambda dr, dc: F.struct((r + dr).alias("row"), (c + dc).alias("col"), ((fv if dr else 1 - fv) * (fu if dc else 1 - fu)).alias("w"))
    four = px.select("k", F.explode(F.array(*[corner(dr, dc) for dr in (0, 1) for dc in (0, 1)])).alias("n")).where("n.w > 0").select("k", "n.*")
    return weighted(four.join(valid, ["row", "col"]), "k", "band")


def sample_zoom(cells: DataFrame, meta: RasterMeta, z: int, resampling: str = "bilinear", tile_size: int = M.TILE_SIZE) -> DataFrame:
    """(band, gx, gy, value) of all pixels with data at a zoom, by area or by centre."""
    if uses_area(meta, z, tile_size):
        return area_average(cells, meta, z, tile_size)
    spark = cells.sparkSession
    near = lambda axis, size: axis_map(spark, meta, z, axis, tile_size).where((F.col("mid") > -1) & (F.col("mid") < size + 1))
    xs, ys = near("x", meta.cols), near("y", meta.rows)
    return nearest(cells, xs, ys) if resampling == "nearest" else bilinear(cells, xs, ys, meta)


def half(cells: DataFrame) -> DataFrame:
    """The next overview: means of 2 x 2 cells, of the valid ones; null where there are none."""
    return cells.groupBy("band", F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.avg("value").alias("value"))


def overviews(cells: DataFrame, rows: int, cols: int, tile_size: int) -> DataFrame:
    """(level, band, row, col, value): level 0 and each overview from the one before, until one tile holds it."""
    levels, now = [cells.select(F.lit(0).alias("level"), "band", "row", "col", "value")], cells
    while max(rows, cols) > tile_size:
        now, rows, cols = half(now), -(-rows // 2), -(-cols // 2)
        levels.append(now.select(F.lit(len(levels)).alias("level"), "band", "row", "col", "value"))
    return reduce(DataFrame.unionByName, levels)


def auto_stretch(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def stretched(value: Column, lo: float, hi: float) -> Column:
    """A byte: scaled by the inverse of the span, clamped, cut off."""
    return F.floor(F.least(F.greatest((value - lo) * F.lit(1.0 / (hi - lo)) * 255.0, F.lit(0.0)), F.lit(255.0))).cast("int")


def rgba(samples: DataFrame, keys: list[str], bands: int, lo: float = 0.0, hi: float = 255.0, size: int = 0) -> DataFrame:
    """(keys, r, g, b, a) of positions with any colour: opaque where all three are there, a fourth band's alpha instead of 255.
    ``size``: how many samples there may be."""
    byte = lambda k: F.max(F.when(F.col("band") == k, stretched(F.col("value"), lo, hi)))
    colours = F.count(F.when(F.col("band") <= 3, F.col("value")))
    one = dealt(samples, size, *keys).groupBy(*keys).agg(*[F.coalesce(byte(k), F.lit(0)).alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))], colours.alias("n"), byte(4).alias("a4")).where("n > 0")
    alpha = F.coalesce("a4", F.lit(255)) if bands == 4 else F.lit(255)
    return one.select(*keys, "r", "g", "b", F.when(F.col("n") == 3, alpha).otherwise(0).alias("a"))
