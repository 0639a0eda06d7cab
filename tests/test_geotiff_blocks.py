"""GeoTIFF by block: partitions, ranges read, filters, bands, BigTIFF, and files of many tasks."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quadrille.codecs import tiff
from quadrille.operators import raster
from quadrille.plans.options import CogOptions, RasterMeta, TileError
from quadrille.sinks import cog, files
from quadrille.sources import geotiff, readers


def cells_of(spark, rows, cols, bands=1, value=lambda b, i, j: (3 * i + 5 * j + 11 * b) % 97):
    every = [(b, i, j, None if (i + j) % 13 == 5 else float(value(b, i, j))) for b in range(1, bands + 1) for i in range(rows) for j in range(cols)]
    return spark.createDataFrame(every, "band int, row long, col long, value double")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """70 x 50 cells in blocks of 16: 5 x 4 of them."""
    meta = RasterMeta(70, 50, 11.0, 48.5, 0.25, 0.125)
    path = str(tmp_path_factory.mktemp("tiff") / "one.tif")
    cog.write_cog(cells_of(spark, 70, 50), meta, path, CogOptions(16))
    return meta, path


def test_a_partition_is_a_block(spark, written):
    meta, path = written
    found, cells = geotiff.scan(spark, path)
    assert found == meta and cells.rdd.getNumPartitions() == 20
    got = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    want = {(r["row"], r["col"]): r["value"] for r in cells_of(spark, 70, 50).collect()}
    assert got == want
    few = spark.read.format("geotiff_blocks").option("partitions", "3").load(path)
    assert few.rdd.getNumPartitions() == 3 and few.count() == 3500


@pytest.mark.parametrize("condition, blocks", [("row >= 16 and row < 32", 4), ("row = 69", 4), ("col in (3, 18)", 10), ("row < 16 and col > 47", 1), ("row > 100", 0), ("value > 50", 20), ("row between 30 and 33 and col between 15 and 16", 4), ("band = 2", 0)])
def test_filters_reach_the_source(spark, written, condition, blocks):
    _, cells = geotiff.scan(spark, written[1])
    some = cells.where(condition)
    assert some.rdd.getNumPartitions() == max(1, blocks)
    assert sorted(map(repr, some.collect())) == sorted(map(repr, cells_of(spark, 70, 50).where(condition).collect()))


def test_only_ranges_are_read(written, monkeypatch):
    reader, opened = geotiff.BlockReader(written[1], None, 1000), []
    monkeypatch.setattr(geotiff, "RangeFile", lambda path, own=geotiff.RangeFile: opened.append(own(path)) or opened[-1])
    list(reader.pushFilters([D.EqualTo(("row",), 20), D.LessThan(("col",), 16)]))
    parts = reader.partitions()
    assert len(parts) == 1 and sum(b.num_rows for b in reader.read(parts[0])) == 256
    assert opened[-1].bytes_read == parts[0].blocks[0].size < os.path.getsize(written[1]) / 10


def test_bands_and_their_order(spark, tmp_path):
    meta, path = RasterMeta(20, 33, 0.0, 10.0, 0.5, 0.5, bands=3), str(tmp_path / "rgb.tif")
    cog.write_cog(cells_of(spark, 20, 33, 3).where("value is not null"), meta, path, CogOptions(16))
    found, cells = geotiff.scan(spark, path, [3, 1, 1])
    assert found.bands == 3
    whole = {(r["band"], r["row"], r["col"]): r["value"] for r in readers.read_geotiff(spark, path, [3, 1, 1])[1].collect()}
    assert {(r["band"], r["row"], r["col"]): r["value"] for r in cells.collect()} == whole
    assert cells.where("band = 2").select("band").distinct().count() == 1
    with pytest.raises(Exception, match="bands"):
        geotiff.scan(spark, path, [1, 2, 4])[1].count()


def big_tiff(values: np.ndarray, order: str) -> bytes:
    """A BigTIFF of one strip for every two rows."""
    h, w = values.shape
    strips = [values[r : r + 2].astype(order + "i2").tobytes() for r in range(0, h, 2)]
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [16]), (259, 3, [1]), (262, 3, [1]), (273, 16, None), (277, 3, [1]), (278, 4, [2]), (279, 16, [len(s) for s in strips]), (339, 3, [2]), (42113, 2, b"-7\0")]
    at = 16 + 8 + 20 * len(entries) + 8
    far = at + 2 * 8 * len(strips)
    offsets = [far + sum(map(len, strips[:k])) for k in range(len(strips))]
    out, more = struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16) + struct.pack(order + "Q", len(entries)), b""
    for tag, kind, v in entries:
        v = offsets if v is None else v
        data = v if kind == 2 else struct.pack(f"{order}{len(v)}{tiff.FORMATS[kind]}", *v)
        out += struct.pack(order + "HHQ", tag, kind, len(v)) + (data.ljust(8, b"\0") if len(data) <= 8 else struct.pack(order + "Q", at + len(more)))
        more += data if len(data) > 8 else b""
    return out + bytes(8) + more + b"".join(strips)


@pytest.mark.parametrize("order", "<>")
def test_big_tiff_of_strips(spark, tmp_path, order):
    values = np.arange(9 * 5).reshape(9, 5) - 10
    (tmp_path / "big.tif").write_bytes(big_tiff(values, order))
    _, cells = geotiff.scan(spark, str(tmp_path / "big.tif"))
    assert cells.rdd.getNumPartitions() == 5
    assert {(r["row"], r["col"]): r["value"] for r in cells.collect()} == {(i, j): None if values[i, j] == -7 else float(values[i, j]) for i in range(9) for j in range(5)}


def test_files_of_one_band_each(spark, tmp_path):
    def file(name, rows=20, x=3.0):
        path = str(tmp_path / name)
        cog.write_cog(cells_of(spark, rows, 17, value=lambda b, i, j: len(name) + i), RasterMeta(rows, 17, x, 10.0, 0.5, 0.5), path, CogOptions(16))
        return path

    a, bb, ccc = file("a"), file("bb", x=3.0 + 1e-11), file("ccc")
    meta, cells = geotiff.scan_files(spark, [a, ccc, bb])
    assert meta.bands == 3 and {r["band"]: r["v"] for r in cells.groupBy("band").agg(F.min("value").alias("v")).collect()} == {1: 1.0, 2: 3.0, 3: 2.0}
    with pytest.raises(TileError, match="elsewhere"):
        geotiff.scan_files(spark, [a, file("far", x=3.0 + 1e-8), bb])
    with pytest.raises(TileError, match="cells"):
        geotiff.scan_files(spark, [a, file("long", rows=21), bb])


def test_description_and_bounds(written):
    about = geotiff.describe(written[1])
    assert (about["cols"], about["rows"], about["bands"], about["crs"], about["nodata"]) == (50, 70, 1, "EPSG:4326", None)
    assert about["bounds"] == (11.0, 39.75, 23.5, 48.5) and about["cell"] == (0.25, 0.125)
    metres = RasterMeta(10, 20, -1113194.9079327357, 1118889.9748579594, 111319.49079327357, 111888.99748579594, "3857")
    assert raster.bounds_degrees(metres) == pytest.approx((-10.0, 0.0, 10.0, 10.0), abs=1e-6)


def test_cog_names_its_own_crs():
    assert cog.own_crs(900913) == "3857" and cog.own_crs(4326) == "4326" and cog.own_crs(32719, "3857") == "3857"
    for epsg in (32719, None):
        with pytest.raises(TileError):
            cog.own_crs(epsg)


def test_a_file_of_many_tasks(spark, tmp_path):
    rows = spark.range(5000).select("id", F.encode(F.concat(F.col("id").cast("string"), F.lit(",")), "utf-8").alias("data")).repartition(7)
    path = str(tmp_path / "numbers")
    made = files.in_order(rows, ["id"])
    assert files.write_rows(made, path, b"[", b"0]") == os.path.getsize(path)
    with open(path) as f:
        assert f.read() == "[" + "".join(f"{k}," for k in range(5000)) + "0]"
    broken = made.withColumn("data", F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        files.write_rows(broken, str(tmp_path / "broken"))
    assert os.listdir(tmp_path) == ["numbers"]
