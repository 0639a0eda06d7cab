"""GeoPackage, MBTiles and GeoParquet: values, ranges of rows, and what comes of odd files."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from quadrille.codecs import image
from quadrille.codecs.webp import webp
from quadrille.plans import tileset
from quadrille.plans.options import TileError
from quadrille.sinks import tiles as sinks
from quadrille.sources import readers, sqlite


def point(x, y, order="<"):
    return struct.pack(order + "BIdd", order == "<", 1, x, y)


def polygon(*rings, order="<"):
    out = struct.pack(order + "BII", order == "<", 3, len(rings))
    return out + b"".join(struct.pack(f"{order}I{2 * len(r)}d", len(r), *[v for p in r for v in p]) for r in rings)


def gpkg_blob(wkb, envelope=0):
    return b"GP\0" + bytes([envelope << 1 | 1]) + struct.pack("<i", 4326) + bytes({0: 0, 1: 32}[envelope]) + wkb


RING, HOLE = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)], [(5.0, 2.0), (7.0, 2.0), (7.0, 4.0), (5.0, 2.0)]


@pytest.fixture(scope="module")
def package(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gpkg") / "a#b.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_geometry_columns(table_name text, column_name text)")
        db.executemany("insert into gpkg_geometry_columns values (?, ?)", [("places", "geom"), ('odd "name"', "shape")])
        db.execute("create table places(fid integer primary key, geom blob, name text, height real, n integer)")
        db.executemany("insert into places values (?, ?, ?, ?, ?)", [(k, gpkg_blob(point(k, -k, "<>"[k % 2]), k % 2) if k % 10 else None, f"p{k}" if k % 3 else None, k / 2, k) for k in range(1, 201)])
        db.execute('create table "odd ""name""" (shape blob, label text)')
        db.execute('insert into "odd ""name""" values (?, ?)', (gpkg_blob(polygon(RING, HOLE)), "x"))
    return path


def test_geopackage_by_ranges_of_rows(spark, package):
    found = readers.read_geopackage(spark, package, "places", rows=30)
    assert found.rdd.getNumPartitions() == 7
    got = {r["feature_ord"]: r for r in found.collect()}
    assert sorted(got) == [k for k in range(1, 201) if k % 10]
    r = got[7]
    assert (r["kind"], r["id"], r["parts"][0][0][0]["x"], r["parts"][0][0][0]["y"]) == ("Point", 7, 7.0, -7.0)
    assert [(p["k"], p["t"], p["i"], p["d"], p["s"]) for p in r["props"]] == [("height", "Float", None, 3.5, None), ("n", "Int", 7, None, None), ("name", "String", None, None, "p7")]
    assert next(p for p in got[9]["props"] if p["k"] == "name")["t"] == "Null"


def test_other_tables_of_a_geopackage(spark, package):
    (r,) = readers.read_geopackage(spark, package, "odd", table='odd "name"').collect()
    assert r["kind"] == "Polygon" and [[(p["x"], p["y"]) for p in ring] for ring in r["parts"][0]] == [RING, HOLE] and r["id"] is None
    with pytest.raises(TileError):
        readers.read_geopackage(spark, package, "none", table="none")


def test_a_file_elsewhere_is_read_from_memory(spark, package, monkeypatch):
    near = sorted(map(str, readers.read_geopackage(spark, package, "places").collect()))
    monkeypatch.setattr(sqlite, "local", lambda path: None)
    assert sorted(map(str, readers.read_geopackage(spark, package.replace("#", "?"), "places").collect())) == near


def test_mbtiles_by_ranges_of_rows(spark, tmp_path):
    tiles = spark.range(500).select(F.lit(9).alias("z"), F.col("id").alias("x"), (511 - F.col("id")).alias("y"), F.encode(F.col("id").cast("string"), "utf-8").alias("data"))
    about = tileset.metadata_rows("many", "pbf", (0.0, 0.0, 1.0, 1.0), 9, 9, '{"vector_layers": [{"id": "a"}]}')
    assert sinks.write_mbtiles(tiles, f"{tmp_path}/m.mbtiles", about) == 500
    named, back = readers.read_mbtiles(spark, f"{tmp_path}/m.mbtiles", rows=100)
    assert back.rdd.getNumPartitions() == 5 and readers.vector_layers(named) == [{"id": "a"}]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tiles.collect()))


def test_geoparquet(spark, tmp_path):
    rows = [(point(1.0, 2.0), "a", 3, 0.5, True), (polygon(RING), None, None, None, None), (None, "no geometry", 1, 1.0, False)]
    spark.createDataFrame([(bytearray(w) if w else None, *r) for w, *r in rows], "geometry binary, s string, i int, d double, b boolean").coalesce(1).write.parquet(f"{tmp_path}/g.parquet")
    got = readers.read_geoparquet(spark, f"{tmp_path}/g.parquet", "x", 2).orderBy("feature_ord").collect()
    assert [(r["layer"], r["layer_ord"], r["kind"]) for r in got] == [("x", 2, "Point"), ("x", 2, "Polygon")]
    assert {p["k"]: (p["t"], p["b"], p["i"], p["d"], p["s"]) for p in got[0]["props"]} == {"b": ("Bool", True, None, None, None), "d": ("Float", None, None, 0.5, None), "i": ("Int", None, 3, None, None), "s": ("String", None, None, None, "a")}
    assert {p["t"] for p in got[1]["props"]} == {"Null"} and got[1]["parts"][0][0][1]["x"] == 9.0


def test_lossless_webp_is_a_fifth_smaller_than_png():
    import numpy as np

    i, j = np.indices((256, 256))
    height = 90 * np.sin(i / 37) * np.cos(j / 23) + (i * 7 + j * 13) % 5 + i / 4
    rgba = image.coloured(height, float(height.min()), float(height.max()), "grayscale")
    assert len(webp(rgba)) <= 0.8 * len(image.png(rgba))
