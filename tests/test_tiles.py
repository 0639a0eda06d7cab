"""Known numbers of tile arithmetic, sampling, geometry, codecs, sources and sinks."""

import gzip
import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.codecs import image, mvt, tiff
from quadrille.functions import mercator as M
from quadrille.functions import sql
from quadrille.operators import raster, vector
from quadrille.plans import tileset
from quadrille.plans.options import CogOptions, MvtOptions, PyramidOptions, RasterMeta, TileError
from quadrille.sinks import cog, tiles as sinks, xyz
from quadrille.sources import readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def grid(spark, rows, cols, value, meta=None, hole=None, bands=1):
    cells = [(b, i, j, None if (i, j) == hole else float(value(b, i, j))) for b in range(1, bands + 1) for i in range(rows) for j in range(cols)]
    return meta, spark.createDataFrame(cells, "band int, row long, col long, value double")


def test_tile_arithmetic(spark):
    # 45 degrees east is five eighths of the way round; on the equator rows begin at the middle
    z = F.lit(5)
    assert one(spark, M.tile_x(z, M.mercator_x(F.lit(45.0))), M.tile_y(z, M.mercator_y(F.lit(0.0))), M.tile_x(z, M.mercator_x(F.lit(44.99)))) == (20, 16, 19)
    # at 60 north y is ln(tan 75) = 1.31696 radii of pi, 0.41920 of the way up: row floor(32 * (1 - 0.41920) / 2)
    assert one(spark, M.tile_y(z, M.mercator_y(F.lit(60.0)))) == (9,)
    assert one(spark, M.resolution(F.lit(3), 512))[0] == pytest.approx(2 * np.pi * 6378137 / 4096)
    exact = 2 * M.ORIGIN_SHIFT_M / (256 * 2**7)
    assert one(spark, *[M.zoom_for_resolution(F.lit(exact * k)) for k in (1, 0.999, 1.5, 1e-9, 1e9)]) == (7, 8, 7, 30, 0)
    assert one(spark, M.tms_row(F.lit(4), F.lit(11))) == (4,)
    side = M.ORIGIN_SHIFT_M / 4  # of a tile at zoom 3
    assert one(spark, *M.tile_range(F.lit(3), F.lit(-side), F.lit(-2 * side), F.lit(2 * side), F.lit(side))) == (3, 5, 3, 5)
    assert one(spark, *M.tile_range(F.lit(3), F.lit(9e8), F.lit(-9e8), F.lit(9e8), F.lit(-9e8))) == (7, 7, 7, 7)
    back = one(spark, M.longitude(M.mercator_x(F.lit(139.75))), M.latitude(M.mercator_y(F.lit(-77.125))))
    assert back == pytest.approx((139.75, -77.125), abs=1e-10)


def test_sampling(spark):
    # 3 rows of 5 cells, half as wide as high; values are products of primes of row and column
    meta, value = RasterMeta(3, 5, 100.0, 46.0, 2.0, 4.0), lambda b, i, j: (2, 3, 5)[i] * (7, 11, 13, 17, 19)[j]
    points = spark.createDataFrame([(1, 105.0, 41.5), (2, 109.999, 34.001), (3, 99.9, 40.0), (4, 104.0, 42.0), (5, 103.0, 40.0), (6, 100.5, 45.5)], "k int, x double, y double")
    at = lambda cells, how: {r["k"]: r["value"] for r in raster.sample_points(cells, points, meta, how).collect()}
    _, cells = grid(spark, 3, 5, value)
    assert at(cells, "nearest") == {1: 3 * 13, 2: 5 * 19, 4: 3 * 13, 5: 3 * 11, 6: 2 * 7}
    smooth = at(cells, "bilinear")
    assert smooth[4] == (2 + 3) * (11 + 13) / 4 and smooth[5] == 3 * 11 and 3 not in smooth
    # near the corner 0.75 * 0.625 of the weight lies within the grid, which is less than half
    assert 6 not in smooth
    _, holed = grid(spark, 3, 5, value, hole=(1, 2))
    assert at(holed, "nearest").keys() == {2, 5, 6}
    assert at(holed, "bilinear")[4] == pytest.approx((2 * 11 + 2 * 13 + 3 * 11) / 3) and 1 not in at(holed, "bilinear")


def test_crs_and_checks():
    assert raster.detect_crs((5.9, 45.8, 10.5, 47.8)) == "4326" and raster.detect_crs((6e5, 5.7e6, 1.2e6, 6.1e6)) == "3857"
    assert raster.detect_crs((6e5, 5.7e6, 1.2e6, 6.1e6), 4326) == "4326" and raster.detect_crs((0, 0, 1, 1), 2056, "3857") == "3857"
    for bad in (lambda: raster.detect_crs((7, 46, 8, 47), 2056), lambda: raster.detect_crs((2.6e6, 1.2e6, 2.6e6 + 300, 1.3e6)), lambda: PyramidOptions(9, 8), lambda: CogOptions(24), lambda: PyramidOptions(stretch=(7, 7)), lambda: RasterMeta(1, 1, 0, 0, 1, 1, bands=5), lambda: readers.layer_spec("name=")):
        with pytest.raises(TileError):
            bad()
    assert readers.layer_spec("lakes=in/swiss.gpkg#seen") == ("lakes", "in/swiss.gpkg", "seen") and readers.layer_spec("in/peaks.v2.json") == ("peaks.v2", "in/peaks.v2.json", None)


def test_overviews_skip_missing(spark):
    _, cells = grid(spark, 2, 2, lambda b, i, j: i * 2 + j, hole=(0, 0))
    assert raster.half(cells).first()["value"] == 2.0


def decoded_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    w, h = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    return np.frombuffer(raw, np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(h, w, 4)


def test_pyramid(spark):
    meta = RasterMeta(48, 40, 7.1, 46.9, 0.004, 0.003)
    _, cells = grid(spark, 48, 40, lambda b, i, j: 3 * i - j)
    rows = tileset.raster_tileset(cells, meta, PyramidOptions(3, 7)).collect()
    assert {r["z"] for r in rows} == {3, 4, 5, 6, 7}
    assert all(decoded_png(bytes(r["data"]))[..., 3].any() for r in rows)
    pixels = np.arange(96, dtype=np.uint8).reshape(3, 8, 4)
    assert (decoded_png(image.png(pixels)) == pixels).all()


def test_a_tile_of_transparent_pixels_is_written(spark):
    """Four bands, of which the last says that nothing shows."""
    meta = RasterMeta(40, 40, 7.1, 46.9, 0.004, 0.003, bands=4)
    _, cells = grid(spark, 40, 40, lambda b, i, j: 0 if b == 4 else 60 * b, bands=4)
    rows = tileset.raster_tileset(cells, meta, PyramidOptions(6, 6)).collect()
    assert rows and all(not decoded_png(bytes(r["data"]))[..., 3].any() and decoded_png(bytes(r["data"]))[..., :3].any() for r in rows)


def test_area_mean_of_a_whole_grid(spark):
    """At zoom 0 a pixel is wider than the grid, which holds the centre of no other pixel."""
    meta = RasterMeta(6, 6, 0.2, 0.9, 0.1, 0.1)
    _, cells = grid(spark, 6, 6, lambda b, i, j: 6 * i + j, hole=(2, 3))
    (r,) = raster.area_average(cells, meta, 0).collect()
    assert (r["gx"], r["gy"]) == (128, 127) and r["value"] == pytest.approx((sum(range(36)) - 15) / 35)


def test_layers_of_metadata():
    assert readers.vector_layers({"json": '{"vector_layers": [{"id": "a"}]}'}) == [{"id": "a"}]
    assert [readers.vector_layers(m) for m in ({}, {"json": "{"}, {"json": "[]"}, {"json": '{"vector_layers": {}}'})] == [None] * 4


def test_functions_in_sql(spark):
    names = sql.register(spark)
    assert "tiles_for_bounds" in names
    got = spark.sql("select tile_x(5, mercator_x(45D)), tile_y(5, mercator_y(60D)), tms_row(4, 11L), zoom_for_resolution(1e9D), round(mercator_lat(mercator_y(-77.125D)), 9), tile_resolution(3, 512)").first()
    assert tuple(got)[:5] == (20, 9, 4, 0, -77.125) and got[5] == pytest.approx(2 * np.pi * 6378137 / 4096)
    side = M.ORIGIN_SHIFT_M / 4
    tiles = spark.sql(f"select k, t.x, t.y from values (1, {-side}D, 0D, {side}D, {side}D), (2, 0D, 0D, 0D, 0D) b(k, x0, y0, x1, y1), lateral tiles_for_bounds(3, x0, y0, x1, y1) t").collect()
    assert sorted(map(tuple, tiles)) == [(1, 3, 3), (1, 4, 3), (2, 4, 4)]


def test_lines_and_rings(spark):
    line = np.array([(-2.0, 0.5), (0.5, 0.5), (2.0, 0.5), (2.0, 5.0), (0.5, 5.0), (0.5, 0.2)])
    parts = vector.clip_line(line, (0, 0, 1, 1))
    assert [p.tolist() for p in parts] == [[[0, 0.5], [0.5, 0.5], [1, 0.5]], [[0.5, 1.0], [0.5, 0.2]]]
    u = np.array([(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)], float)
    assert len(vector.clip_polygons([[u]], (-1, 2, 4, 4))) == 2
    holed = vector.clip_polygons([[np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float), np.array([(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)], float)]], (-1, -1, 3, 5))
    assert len(holed) == 1 and len(holed[0]) == 2
    assert len(vector.simplify(np.array([(0, 0), (1, 0.1), (2, 0), (3, 5)], float), 0.5)) == 3
    ring = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (0, 4), (4, 4), (4, 0), (0, 0))])
    turned, flat = one(spark, vector.doubled_area(vector.wound_ring(ring, True)), vector.wound_ring(F.slice(ring, 1, 2), True))
    assert turned == 32 and flat is None


def test_lines_are_cut_and_simplified_together_as_they_are_one_by_one():
    rng = np.random.default_rng(4)
    lines = [rng.integers(0, 12, (n, 2)).astype(float) for n in rng.integers(1, 40, 300)] + [np.array([(3.0, 3.0)] * 4), np.empty((0, 2))]
    at, rects = np.concatenate([[0], np.cumsum([len(p) for p in lines])]), np.array([(2.0, 3.0, 5.0 + k % 7, 8.0) for k in range(len(lines))])
    xy, cut_at, line = vector.clip_lines(np.concatenate(lines), at, rects)
    one_by_one = [(k, piece) for k, p in enumerate(lines) for piece in vector.clip_line(p, rects[k])]
    assert line.tolist() == [k for k, _ in one_by_one] and all(np.array_equal(xy[i:j], p) for i, j, (_, p) in zip(cut_at[:-1], cut_at[1:], one_by_one))

    def kept(p, tolerance):  # by recursion
        if len(p) < 3:
            return p
        d, v = p[-1] - p[0], p[1:-1] - p[0]
        t = np.clip(v @ d / (d @ d), 0, 1)[:, None] if d.any() else 0.0
        far = np.hypot(*(v - t * d).T)
        k = int(np.argmax(far)) + 1
        return np.vstack([kept(p[: k + 1], tolerance)[:-1], kept(p[k:], tolerance)]) if far[k - 1] > tolerance else p[[0, -1]]

    lines = [rng.normal(size=(n, 2)).cumsum(0) for n in rng.integers(2, 200, 200)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in lines])])
    for tolerance in (0.5, 2.0, 50.0):
        keep = vector.simplify_all(np.concatenate(lines), at, tolerance)
        assert all(np.array_equal(p[keep[i:j]], kept(p, tolerance)) for p, i, j in zip(lines, at[:-1], at[1:]))
    assert vector.simplify_all(np.concatenate(lines), at, 50.0, 4)[: at[1]].sum() in (len(lines[0]), *range(4, len(lines[0])))


LAKE = [[18.2, 59.1], [18.9, 59.05], [19.3, 59.6], [18.6, 59.9], [18.1, 59.5], [18.2, 59.1]]
ISLAND = [[18.5, 59.4], [18.6, 59.4], [18.6, 59.5], [18.5, 59.4]]
COLLECTION = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"depth_m": 31.25, "label": "lake", "source": None}, "geometry": {"type": "Polygon", "coordinates": [LAKE, ISLAND]}},
    {"type": "Feature", "id": "907", "properties": {"lanes": 2, "tags": ["ferry", "winter"]}, "geometry": {"type": "MultiLineString", "coordinates": [[[18.3, 59.2], [18.7, 59.45], [19.1, 59.5]], [[18.2, 59.8], [18.4, 59.7]]]}},
    {"type": "Feature", "properties": {}, "geometry": None},
    {"type": "Feature", "properties": None, "geometry": {"type": "MultiPoint", "coordinates": [[18.55, 59.45], [18.8, 59.3]]}}]}


def test_geojson_to_tiles(spark, tmp_path):
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps(COLLECTION))
    features = readers.read_layers(spark, [f"a={path}"])
    rows = {r["feature_ord"]: r for r in features.collect()}
    assert len(rows) == 3 and sorted(r["id"] for r in rows.values() if r["id"] is not None) == [907] and [p["k"] for p in rows[0]["props"]][:1] == ["depth_m"]
    assert {p["k"]: p["t"] for p in rows[1]["props"]} == {"lanes": "Int", "tags": "String"}
    made = tileset.vector_tileset(features, MvtOptions(0, 8)).collect()
    assert len(made) >= 9 and all(gzip.decompress(bytes(r["data"]))[0] == 0x1A for r in made)
    fields = json.loads(tileset.vector_layers_json(features, MvtOptions(0, 8)))["vector_layers"][0]["fields"]
    assert fields["label"] == "String" and fields["depth_m"] == "Number" and "source" not in fields
    with pytest.raises(TileError):
        readers.read_layers(spark, [str(path), str(path)])


def test_small_square_shows_only_close_up(spark):
    square = [[[{"x": x, "y": y} for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0))]]]
    f = spark.createDataFrame([("a", 0, 0, "Polygon", square, None, None)], vector.FEATURE)
    seen = {r["z"] for r in tileset.feature_tiles(f, MvtOptions(2, 14)).collect()}
    assert 2 not in seen and 14 in seen


def test_large_polygon_descends(spark):
    """5,000 vertices over 11 zooms: each tile holds the share that a direct cut gives."""
    a = np.linspace(0, 2 * np.pi, 5001)
    r = 2e6 * (1 + 0.2 * np.sin(40 * a))
    ring = np.column_stack([r * np.cos(a), r * np.sin(a)])
    line = np.column_stack([np.linspace(-3e6, 3e6, 3000), 4e5 * np.sin(np.arange(3000) / 9)])
    as_parts = lambda p: [[[{"x": float(x), "y": float(y)} for x, y in p]]]
    f = spark.createDataFrame([("a", 0, 0, "Polygon", as_parts(ring), None, None), ("a", 0, 1, "LineString", as_parts(line), None, None)], vector.FEATURE)
    options = MvtOptions(0, 10, simplify=0.0)
    rows = vector.clipped_tiles(f, options).where("z in (0, 3, 7) or z = 10 and x % 8 = 0 and y % 8 = 0").collect()

    def area(polys):
        return sum((-1) ** (k > 0) * abs(np.sum(q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1])) / 2 for poly in polys for k, q in enumerate(poly))

    length = lambda polys: sum(np.hypot(*np.diff(q, axis=0).T).sum() for poly in polys for q in poly)
    assert len(rows) == len({(r["feature_ord"], r["z"], r["x"], r["y"]) for r in rows}) > 400
    for row in rows:
        got = [[np.array([(p["x"], p["y"]) for p in q]) for q in poly] for poly in row["parts"]]
        rect = vector.buffered_rect(row["z"], row["x"], row["y"], options.buffer / options.extent)
        measure = area if row["feature_ord"] == 0 else length
        assert measure(got) == pytest.approx(measure(vector.clip(row["kind"], [[ring if row["feature_ord"] == 0 else line]], rect)), rel=1e-6, abs=1e-3)
    shown = {(r["x"], r["y"]) for r in rows if r["z"] == 7 and r["feature_ord"] == 0}
    every = {(x, y) for x in range(52, 76) for y in range(52, 76) if vector.clip("Polygon", [[ring]], vector.buffered_rect(7, x, y, 64 / 4096))}
    x0, x1, y0, y1 = one(spark, *M.tile_range(F.lit(7), *(F.lit(float(v)) for v in (min(ring[:, 0].min(), -3e6), ring[:, 1].min(), max(ring[:, 0].max(), 3e6), ring[:, 1].max()))))
    assert shown == {(x, y) for x, y in every if x0 <= x <= x1 and y0 <= y <= y1}


def test_clipping_without_features(spark):
    none = spark.createDataFrame([], vector.FEATURE)
    assert tileset.feature_tiles(none, MvtOptions(0, 4)).count() == 0
    empty = spark.createDataFrame([("a", 0, 0, "LineString", [[[]]], None, None), ("a", 0, 1, "Point", [[[{"x": 1.0, "y": 2.0}]]], None, None)], vector.FEATURE)
    assert sorted((r["z"], r["feature_ord"]) for r in tileset.feature_tiles(empty, MvtOptions(0, 6)).collect())[0] == (0, 1)


def test_sinks(spark, tmp_path):
    made = spark.createDataFrame([(0, 0, 0, bytearray(b"t")), (3, 2, 0, bytearray(b"u"))], tileset.TILE)
    about = tileset.metadata_rows("peaks", "png", (6.5, -0.25, 9.0, 47.125), 0, 3)
    assert dict(about)["bounds"] == "6.5,-0.25,9,47.125" and dict(about)["center"] == "7.75,23.4375,0"
    assert sinks.write_mbtiles(made, f"{tmp_path}/t.mbtiles", about) == 2
    with sqlite3.connect(f"{tmp_path}/t.mbtiles") as db:
        assert db.execute("select tile_row from tiles where zoom_level = 3").fetchall() == [(7,)]
    named, back = readers.read_mbtiles(spark, f"{tmp_path}/t.mbtiles")
    assert named["maxzoom"] == "3" and {tuple(r)[:3] for r in back.collect()} == {(0, 0, 0), (3, 2, 0)}
    assert xyz.write_xyz(made, f"{tmp_path}/xyz", "png", about) == 2 and (tmp_path / "xyz/3/2/0.png").read_bytes() == b"u"
    assert json.loads((tmp_path / "xyz/metadata.json").read_text())["scheme"] == "xyz"
    sinks.write_parquet(made, f"{tmp_path}/p")
    assert readers.lookup(spark.read.parquet(f"{tmp_path}/p"), 3, 2, 0).count() == 1


def test_cog_round_trip(spark, tmp_path):
    meta = RasterMeta(20, 20, -71.0, -33.0, 0.01, 0.01)
    _, cells = grid(spark, 20, 20, lambda b, i, j: i + j)
    info = cog.write_cog(cells, meta, f"{tmp_path}/c.tif", CogOptions(16))
    assert info["levels"] == 2 and (tmp_path / "c.tif").read_bytes()[:4] == b"II*\0"
    back, values = readers.read_geotiff(spark, f"{tmp_path}/c.tif")
    assert back.origin_x == meta.origin_x and back.crs == "4326" and values.where("row = 5 and col = 7").first()["value"] == 12
    assert values.count() == 400
    assert tiff.epsg(tiff.first_directory((tmp_path / "c.tif").read_bytes())[1]) == 4326


def lzw_packed(data):
    """The opposite of tiff.lzw, as a plain bit string."""
    out, table, width = [], {bytes([i]): i for i in range(256)}, 9
    emit = lambda code: out.append(format(code, f"0{width}b"))
    emit(256)
    n, held = 258, b""
    for k in range(len(data)):
        longer = held + data[k : k + 1]
        if longer in table:
            held = longer
            continue
        emit(table[held])
        table[longer], n, held = n, n + 1, data[k : k + 1]
        if n == 4095:
            emit(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif n in (512, 1024, 2048):
            width += 1
    if held:
        emit(table[held])
        if n + 1 in (512, 1024, 2048):
            width += 1
    emit(257)
    text = "".join(out)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def small_tiff(values, coding, predictor, planar):
    """A striped little-endian TIFF of two rows a strip over (rows, cols, bands)."""
    rows, cols, bands = values.shape
    encode = {1: bytes, 5: lzw_packed, 8: zlib.compress, 32773: lambda d: b"".join(bytes([0, x]) for x in d) + bytes([128])}[coding]
    planes = [values[..., b : b + 1] for b in range(bands)] if planar == 2 else [values]
    strips = []
    for p in planes:
        for r in range(0, rows, 2):
            part = p[r : r + 2]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            raw = part.tobytes()
            if predictor == 3:
                size, one_row = part.dtype.itemsize, []
                for row in part:
                    b = np.frombuffer(row.astype(part.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(-1, size).T.reshape(-1, row.shape[1])
                    one_row.append(np.diff(b, axis=0, prepend=np.zeros_like(b[:1])).tobytes())
                raw = b"".join(one_row)
            strips.append(encode(raw))
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = {256: [cols], 257: [rows], 258: [values.dtype.itemsize * 8] * bands, 259: [coding], 273: [0] * len(strips), 277: [bands], 278: [2], 279: [len(s) for s in strips], 284: [planar], 317: [predictor], 339: [kind] * bands}
    far = 10 + 12 * len(tags) + 4
    at = far + sum(4 * len(v) for v in tags.values() if len(v) > 1)
    for s in strips:
        tags[273][sum(x > 0 for x in tags[273])] = at
        at += len(s)
    head, more = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, v in sorted(tags.items()):
        data = struct.pack(f"<{len(v)}I", *v)
        head += struct.pack("<HHI", tag, 4, len(v)) + (data if len(v) == 1 else struct.pack("<I", far + len(more)))
        more += data if len(v) > 1 else b""
    return head + bytes(4) + more + b"".join(strips)


@pytest.mark.parametrize("coding", [1, 5, 8, 32773])
@pytest.mark.parametrize("planar", [1, 2])
def test_tiff_codings(coding, planar):
    rng = np.random.default_rng(7)
    whole = rng.integers(0, 60000, (5, 400, 3)).astype(np.uint16)
    real = rng.normal(0, 50, (5, 40, 3)).astype(np.float32)
    for values, predictor in ((whole, 1), (whole, 2), (whole.astype(np.int32) - 30000, 2), (whole.astype(np.uint8), 2), (real, 1), (real, 3), (real.astype(float), 3)):
        got = np.full(values.shape, np.nan)
        for r, c, band, block in tiff.blocks(small_tiff(values, coding, predictor, planar)):
            got[r : r + block.shape[0], c : c + block.shape[1], band : band + block.shape[2]] = block
        assert (got == values).all()
    with pytest.raises(ValueError):
        next(tiff.blocks(small_tiff(real, 1, 2, 1)))


def test_lzw_known_codes():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    text = "".join(format(c, "09b") for c in codes)
    assert tiff.lzw(int(text.ljust(88, "0"), 2).to_bytes(11, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    long = bytes(np.random.default_rng(3).integers(0, 9, 60000, dtype=np.uint8))
    assert tiff.lzw(lzw_packed(long)) == long and tiff.packbits(bytes([254, 170, 2, 128, 0, 42, 128, 253, 170])) == bytes([170] * 3 + [128, 0, 42] + [170] * 4)


def test_geotiff_bands_and_rgb_cog(spark, tmp_path):
    path = tmp_path / "b.tif"
    values = np.arange(4 * 5 * 3, dtype=np.uint16).reshape(4, 5, 3)
    path.write_bytes(small_tiff(values, 5, 2, 2))
    meta, cells = readers.read_geotiff(spark, str(path), [3, 2, 1], "4326")
    got = {(r["band"], r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert meta.bands == 3 and all(got[k + 1, i, j] == values[i, j, b - 1] for k, b in enumerate((3, 2, 1)) for i in range(4) for j in range(5))
    meta, cells = grid(spark, 40, 30, lambda b, i, j: 60 * b + i, RasterMeta(40, 30, 12.0, 48.0, 0.01, 0.01, bands=3), bands=3)
    info = cog.write_cog(cells, meta, f"{tmp_path}/rgb.tif", CogOptions(16))
    data = (tmp_path / "rgb.tif").read_bytes()
    _, tags = tiff.first_directory(data)
    assert info["bytes"] == len(data) and tags[tiff.SAMPLES] == (3,) and tags[tiff.PHOTOMETRIC] == (2,)
    _, back = readers.read_geotiff(spark, f"{tmp_path}/rgb.tif")
    # the linear stretch is cut, not rounded, so 24 of the 256 byte values come out one lower
    expected = F.floor((60 * F.col("band") + F.col("row")) * F.lit(1 / 255) * 255)
    assert back.where(F.col("value") != expected).count() == 0 and back.count() == 3 * 40 * 30


def test_features_are_encoded_in_order():
    data = mvt.tile([("a", [{"id": 7, "kind": "Point", "geom": [[(1, 2)]], "props": [{"k": "x", "t": "Null", "b": None, "i": None, "d": None, "s": None}]}]), ("empty", [])], 4096)
    assert data[0] == 0x1A and b"empty" not in data and mvt.commands("Point", [[(1, 2)]]) == bytes([9, 2, 4])
    assert readers.answer("pbf", True) == (200, "application/x-protobuf", "gzip") and readers.answer("png", False)[0] == 204
