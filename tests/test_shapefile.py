"""Shapefiles made by hand byte by byte, and ones that the sink writes."""

import struct

import pytest
from pyspark.sql import functions as F

from quadrille.operators.vector import PARTS, PROP
from quadrille.plans.options import TileError
from quadrille.sinks import shapefile as shapefiles
from quadrille.sinks.shapefile import write_shapefile
from quadrille.sources import readers, shapefile

#: Clockwise squares and a hole against the clock.
OUTER = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
INNER = [(2, 2), (2, 8), (8, 8), (8, 2), (2, 2)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
ASIDE = [(20, 0), (20, 5), (25, 5), (25, 0), (20, 0)]


def many(code, *lines, extra=b""):
    flat = [v for line in lines for p in line for v in p]
    starts = [sum(map(len, lines[:k])) for k in range(len(lines))]
    return struct.pack(f"<i4dii{len(lines)}i{len(flat)}d", code, min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2]), len(lines), len(flat) // 2, *starts, *flat) + extra


def save(folder, shapes, fields, rows, gap=0, encoding=None):
    """fields: (name, letter, width, decimals); rows: text of all fields, with the mark of deletion."""
    body, index = b"", b""
    for k, s in enumerate(shapes):
        index += struct.pack(">ii", (100 + len(body)) // 2, len(s) // 2)
        body += struct.pack(">ii", k + 1, len(s) // 2) + s + bytes(gap)
    head = bytes(100)
    table = b"".join(n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([w, d]) + bytes(14) for n, t, w, d in fields)
    width = 1 + sum(f[2] for f in fields)
    assert all(len(r) == width for r in rows)
    path = f"{folder}/made.shp"
    open(path, "wb").write(head + body)
    open(f"{folder}/made.shx", "wb").write(head + index)
    open(f"{folder}/made.dbf", "wb").write(struct.pack("<4BIHH", 3, 99, 1, 1, len(rows), 33 + len(table), width) + bytes(20) + table + b"\r" + b"".join(rows))
    if encoding:
        open(f"{folder}/made.cpg", "w").write(encoding)
    return path


def shown(df):
    pairs = lambda parts: [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in parts]
    return [(r["feature_ord"], r["kind"], pairs(r["parts"])) for r in df.orderBy("feature_ord").collect()]


@pytest.mark.parametrize("gap", [0, 3 << 20])
def test_areas_of_every_form(spark, tmp_path, gap):
    shapes = [many(5, OUTER, HOLE), many(5, HOLE, ASIDE, OUTER, INNER[::-1]), struct.pack("<i", 0), many(15, ASIDE, extra=bytes(16 + 40)), many(5, OUTER, INNER, HOLE), many(5, HOLE)]
    path = save(tmp_path, shapes, [("n", "N", 3, 0)], [b" %3d" % k for k in range(6)], gap)
    found = shapefile.scan(spark, path, "a", rows=2)
    assert found.rdd.getNumPartitions() == 3
    assert shown(found) == [
        (0, "Polygon", [[OUTER, HOLE]]), (1, "MultiPolygon", [[ASIDE], [OUTER, HOLE, INNER[::-1]]]), (3, "Polygon", [[ASIDE]]),
        (4, "MultiPolygon", [[OUTER], [INNER, HOLE]]), (5, "Polygon", [[HOLE]])]


def test_lines_points_and_values(spark, tmp_path):
    line, other = [(1, 2), (3, 4), (5, 7)], [(9, 9), (8, 8)]
    shapes = [many(3, line), many(13, line, other, extra=bytes(16 + 5 * 8)), many(3, other), many(3, other)]
    fields = [("b", "L", 1, 0), ("a", "C", 4, 0), ("f", "N", 6, 2), ("i", "N", 20, 0), ("d", "D", 8, 0), ("g", "F", 9, 0)]
    rows = [" Tüx  ".encode("latin-1") + b"  1.50" + b"%20d" % -5 + b"20240229" + b" 1.25e+02", b" ?    " + b"******" + b" " * 20 + b"        " + b"   oddity", b"*F    " + b"  0.00" + b"%20d" % 0 + b"00000000" + b"        0", b" n no " + b"     2" + b"99999999999999999999" + b"00000000" + b"        0"]
    got = shapefile.scan(spark, save(tmp_path, shapes, fields, rows), "a", rows=3)
    assert shown(got) == [(0, "LineString", [[line]]), (1, "MultiLineString", [[line], [other]]), (3, "LineString", [[other]])]
    values = {r["feature_ord"]: {p["k"]: next((v for v in (p["b"], p["i"], p["d"], p["s"]) if v is not None), p["t"]) for p in r["props"]} for r in got.collect()}
    assert values[0] == {"a": "üx", "b": True, "d": "2024-02-29", "f": 1.5, "g": 125.0, "i": -5}
    assert set(values[1].values()) == {"Null"}
    assert values[3] == {"a": "no", "b": False, "d": "Null", "f": 2.0, "g": 0.0, "i": 1e20}
    points = [struct.pack("<i2d", 1, 4, 5), struct.pack("<i3d", 11, 6, 7, 1), struct.pack("<i4di4d", 8, 0, 0, 1, 1, 2, 0, 1, 1, 0)]
    path = save(tmp_path, points, [("s", "C", 3, 0)], [" éa".encode().ljust(4)] * 3, encoding="UTF-8")
    found = shapefile.scan(spark, path, "p")
    assert shown(found) == [(0, "Point", [[[(4, 5)]]]), (1, "Point", [[[(6, 7)]]]), (2, "MultiPoint", [[[(0, 1), (1, 0)]]])]
    assert {r["props"][0]["s"] for r in found.collect()} == {"éa"}
    assert readers.read_layers(spark, [f"here={path}"], "3857").count() >= 2


def test_empty_and_broken(spark, tmp_path):
    assert shapefile.scan(spark, save(tmp_path, [], [("n", "N", 3, 0)], []), "a").count() == 0
    with pytest.raises(TileError):
        shapefile.scan(spark, save(tmp_path, [struct.pack("<i", 0)], [("n", "N", 3, 0)], []), "a")
    with pytest.raises(TileError):
        shapefile.scan(spark, f"{tmp_path}/none.shp", "a")


def features(spark, rows):
    """rows: (order, kind, parts, values)."""
    typed = lambda v: ("Null", None, None, None, None) if v is None else ("Bool", v, None, None, None) if isinstance(v, bool) else ("Int", None, v, None, None) if isinstance(v, int) else ("Float", None, None, v, None) if isinstance(v, float) else ("String", None, None, None, v)
    made = [("x", 0, k, kind, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts], None if values is None else [(n, *typed(v)) for n, v in values.items()]) for k, kind, parts, values in rows]
    return spark.createDataFrame(made, f"layer string, layer_ord int, feature_ord long, kind string, parts {PARTS}, props {PROP}").withColumn("id", F.lit(None).cast("decimal(20,0)"))


def test_round_trip_of_areas_and_values(spark, tmp_path):
    values = [{"name": "grün ☃", "n": 2**63 - 1, "f": 0.1, "ok": True}, {"name": None, "n": -3, "f": 7, "ok": None}, None]
    layer = features(spark, [(k * 5, *shape, values[k % 3]) for k, shape in enumerate([("Polygon", [[OUTER[::-1], HOLE[::-1]]]), ("MultiPolygon", [[OUTER, HOLE], [ASIDE]])] * 40)]).repartition(7)
    path = f"{tmp_path}/areas.shp"
    assert write_shapefile(layer, path) == 80
    back = shapefile.scan(spark, path, "x", rows=9)
    assert shown(back) == [(k, "Polygon" if k % 2 == 0 else "MultiPolygon", [[OUTER, HOLE]] + [[ASIDE]] * (k % 2)) for k in range(80)]
    props = [[(p["k"], p["t"], p["b"], p["i"], p["d"], p["s"]) for p in r["props"]] for r in back.orderBy("feature_ord").limit(3).collect()]
    assert props[0] == [("f", "Float", None, None, 0.1, None), ("n", "Int", None, 2**63 - 1, None, None), ("name", "String", None, None, None, "grün ☃"), ("ok", "Bool", True, None, None, None)]
    assert props[1] == [("f", "Float", None, None, 7.0, None), ("n", "Int", None, -3, None, None), ("name", "Null", None, None, None, None), ("ok", "Null", None, None, None, None)]
    assert {p[1] for p in props[2]} == {"Null"}
    raw = open(path, "rb").read()
    assert struct.unpack_from(">i", raw, 24)[0] * 2 == len(raw) and struct.unpack_from("<2i4d", raw, 28) == (1000, 5, 0, 0, 25, 10)
    at, numbers = 100, []
    while at < len(raw):
        number, words = struct.unpack_from(">ii", raw, at)
        numbers.append(number)
        at += 8 + 2 * words
    assert numbers == list(range(1, 81))


@pytest.mark.parametrize("rows", [
    [(0, "Point", [[[(1, 2)]]], {}), (1, "LineString", [[[(1, 2), (3, 4)]]], {})], [(0, "Point", [[[(1, 2)]]], {"a": 1}), (1, "Point", [[[(1, 2)]]], {"a": "x"})],
    [(0, "Point", [[[(1, 2)]]], {"a": "x" * 255})], [(0, "Point", [[[(1, 2)]]], {"elevenchars": 1})],
])
def test_what_does_not_fit_is_refused(spark, tmp_path, rows):
    with pytest.raises(TileError):
        write_shapefile(features(spark, rows), f"{tmp_path}/x.shp")


def test_no_features_make_an_empty_file(spark, tmp_path):
    assert write_shapefile(features(spark, [(0, "Point", [[[(1, 2)]]], {})]).where("feature_ord > 0"), f"{tmp_path}/x.shp") == 0
    assert shapefile.scan(spark, f"{tmp_path}/x.shp", "x").count() == 0


def test_many_ranges_share_tasks_and_features_are_dealt_out_by_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapefiles, "RECORDS", 100)
    point = F.array(F.array(F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")))))
    prop = F.array(F.struct(F.lit("k").alias("k"), F.lit("Int").alias("t"), F.lit(None).cast("boolean").alias("b"), F.col("id").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("string").alias("s")))
    features = spark.range(0, 1_000, 1, 1).select(F.lit("p").alias("layer"), F.lit(0).alias("layer_ord"), F.col("id").alias("feature_ord"), F.lit("Point").alias("kind"), point.alias("parts"), F.col("id").cast("decimal(20,0)").alias("id"), prop.alias("props"))
    sizes, in_order = [], shapefiles.files.in_order
    monkeypatch.setattr(shapefiles.files, "in_order", lambda *a: sizes.append(n := in_order(*a)) or n)
    assert shapefiles.write_shapefile(features, f"{tmp_path}/p.shp") == 1_000
    assert sizes[0].select("part").distinct().count() == 10
    found = shapefile.scan(spark, f"{tmp_path}/p.shp", "p", rows=3)
    assert found.rdd.getNumPartitions() == shapefile.TASKS * spark.sparkContext.defaultParallelism
    assert [(r["feature_ord"], r["i"]) for r in found.select("feature_ord", F.col("props")[0]["i"].alias("i")).orderBy("feature_ord").collect()] == [(k, k) for k in range(1_000)]
