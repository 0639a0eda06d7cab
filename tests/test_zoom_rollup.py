"""Area means of several zooms from one pass, and what an action counts while it writes."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions import mercator as M
from quadrille.operators import raster
from quadrille.plans import tileset, views
from quadrille.plans.options import PyramidOptions, RasterMeta
from quadrille.sinks import tiles as sinks

RES = 2 * M.ORIGIN_SHIFT_M / (256 * 2.0**10)  # of a pixel at zoom 10


def cells_of(spark, rows, cols):
    at = F.col("id")
    return spark.range(rows * cols).select(F.lit(1).alias("band"), F.floor(at / cols).alias("row"), (at % cols).alias("col"), F.when(at % 7 != 3, (at * 31 % 101).cast("double")).alias("value"))


def both(spark, meta, zooms):
    """Area means by the pyramid and zoom by zoom, and which zooms were rolled up."""
    cells = cells_of(spark, meta.rows, meta.cols)
    got = {(r["z"], r["gx"], r["gy"]): r["value"] for r in raster.area_pyramid(cells, meta, zooms).collect()}
    want = {(z, r["gx"], r["gy"]): r["value"] for z in zooms for r in raster.area_average(cells, meta, z).collect()}
    return got, want, raster.rolled_zooms(meta, zooms, spark)


@pytest.mark.parametrize("meta, rolled", [
    # cells of a tenth of a pixel, off its edges
    (RasterMeta(90, 70, 1000 * RES + 0.013 * RES, 500 * RES, RES / 10, RES / 10, "3857"), [7, 8, 9]),
    # a cell's centre on the edges of all pixels: it belongs to both sides, and at each zoom to others, as rounding has it
    (RasterMeta(90, 70, 1000 * RES - RES / 20, 500 * RES, RES / 10, RES / 10, "3857"), None),
    # degrees
    (RasterMeta(80, 60, 20.0021, 41.0013, 0.0007, 0.0007), [7, 8, 9]),
])
def test_rolled_up_means_are_those_of_each_zoom(spark, meta, rolled):
    got, want, found = both(spark, meta, [7, 8, 9, 10])
    assert sorted(found) == rolled if rolled else len(found) < 3
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())


def test_thin_pixels_are_averaged_by_themselves(spark):
    # near the pole pixels are narrower than cells on one axis
    got, want, found = both(spark, RasterMeta(30, 40, 10.0, 84.9, 0.01, 0.01), [5, 6, 7])
    assert 7 not in found
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())


def test_one_scan_for_all_zooms(spark):
    meta, cells = views.grid(spark, "/root/testdata/sf0.001")
    assert len(raster.rolled_zooms(meta, [4, 5, 6, 7, 8], spark)) == 4
    plan = raster.area_pyramid(cells, meta, [4, 5, 6, 7, 8])
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_what_the_action_counts(spark, tmp_path):
    meta, cells = views.grid(spark, "/root/testdata/sf0.001")
    options = PyramidOptions(6, 9)
    made, seen = tileset.observed(tileset.raster_tileset(cells, meta, options), tileset.zooms(meta, options))
    sinks.write_parquet(made, str(tmp_path / "tiles"))
    got = {r["z"]: r for r in tileset.progress(seen, meta, options)}
    back = spark.read.parquet(str(tmp_path / "tiles"))
    want = {r["z"]: (r["n"], r["b"]) for r in back.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("b")).collect()}
    assert {z: (r["written"], r["bytes"]) for z, r in got.items()} == want
    stats = {r["z"]: (r["written"], r["skipped"]) for r in tileset.stats(back, meta, options).collect()}
    assert {z: (r["written"], r["skipped"]) for z, r in got.items()} == stats


def test_feature_totals(spark):
    d = "/root/testdata/sf0.001"
    given, seen = tileset.feature_totals(views.point_features(spark, d).unionByName(views.box_features(spark, d)))
    given.write.format("noop").mode("overwrite").save()
    assert seen.get == {"features": 160, "layers": 2}


def test_size_report(spark):
    tiles = spark.range(1, 1001).select(F.lit(3).alias("z"), (F.col("id") % 8).alias("x"), F.col("id").alias("y"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8").alias("data"))
    (r,) = tileset.sizes_report(tiles, limit=900).collect()
    assert (r["z"], r["tiles"], r["oversize"], r["largest"]) == (3, 1000, 100, 1000) and abs(r["median"] - 500) <= 1 and abs(r["p99"] - 990) <= 1
    assert [x["bytes"] for x in tileset.heaviest(tiles, 3).collect()] == [1000, 999, 998]


def test_large_grids_are_dealt_out_by_their_size(spark, monkeypatch):
    bands = 4
    meta = RasterMeta(60, 50, 10.0, 20.0, 0.01, 0.01, bands=bands)
    cells = spark.range(meta.rows * meta.cols * bands).selectExpr(f"cast(id % {bands} + 1 as int) band", f"id div {bands} div 50 as row", f"id div {bands} % 50 as col", "case when id % 11 > 0 then cast(id * 7919 % 256 as double) end value")
    options = PyramidOptions(7, 8, stretch=(0.0, 255.0))

    def made():
        tiles = tileset.raster_tileset(cells, meta, options)
        pixels = {(r["z"], r["band"], r["gx"], r["gy"]): r["value"] for r in tileset.pixels(cells, meta, options).collect()}
        return {(r["z"], r["x"], r["y"]): bytes(r["data"]) for r in tiles.collect()}, pixels

    assert raster.dealt(cells, 6000, "row") is cells and "_r" not in raster.in_blocks(cells, meta).columns
    whole = made()
    monkeypatch.setattr(raster, "TASK_ROWS", 800)
    assert raster.in_blocks(cells, meta).rdd.getNumPartitions() == 15 > 8
    dealt = made()
    assert whole[1].keys() == dealt[1].keys() and all(abs(v - dealt[1][k]) < 1e-9 for k, v in whole[1].items()) and len(whole[1]) > 100
    assert whole[0] == dealt[0]
