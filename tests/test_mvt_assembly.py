"""Vector tiles in two stages: partial layers, their merge, and what decoders see."""

import gzip
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.codecs import mvt
from quadrille.operators import vector
from quadrille.plans import tileset, views
from quadrille.plans.options import MvtOptions


def prop(k, v):
    t = "Null" if v is None else "Bool" if isinstance(v, bool) else "Int" if isinstance(v, int) else "Float" if isinstance(v, float) else "String"
    return {"k": k, "t": t, "b": v if t == "Bool" else None, "i": v if t == "Int" else None, "d": v if t == "Float" else None, "s": v if t == "String" else None}


def features(n, seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind = rng.choice(["Point", "MultiPoint", "LineString", "Polygon"])
        many = {"Point": 1, "Polygon": rng.randrange(4, 60)}.get(kind, rng.randrange(2, 60))
        geom = [np.array([(rng.randrange(-64, 4160), rng.randrange(-64, 4160)) for _ in range(many)]) for _ in range(1 if kind in ("Point", "LineString") else 2)]
        values = {"name": rng.choice(["a", "b", "\u00e9"]), "n": rng.randrange(-5, 5), "big": -(2**63), "d": rng.choice([0.5, -1e300]), "ok": rng.random() < 0.5, "none": None}
        out.append({"id": rng.choice([None, k, 2**64 - 1]), "kind": kind, "geom": geom, "props": [prop(c, v) for c, v in values.items() if rng.random() < 0.7]})
    return out


def test_decoding_gives_back_what_was_encoded():
    given = features(200)
    (layer,) = mvt.decode(mvt.tile([("roads", given)], 4096))
    assert (layer["name"], layer["extent"], layer["version"], len(layer["features"])) == ("roads", 4096, 2, 200)
    for a, b in zip(given, layer["features"]):
        assert b["id"] == a["id"] and b["kind"] == a["kind"].removeprefix("Multi")
        points = [[tuple(p) for p in part.tolist()] for part in a["geom"]]
        assert b["geom"] == ([[p] for part in points for p in part] if "Point" in a["kind"] else points)
        assert b["props"] == {p["k"]: next(p[c] for c in "bids" if p[c] is not None) for p in a["props"] if p["t"] != "Null"}


def test_known_bytes():
    # a point at (25, 17): one move, zigzag 50 and 34
    assert mvt.commands("Point", [np.array([(25, 17)])]) == bytes([9, 50, 34])
    # the ring (3, 6), (8, 12), (20, 34): move, two lines, close
    assert mvt.commands("Polygon", [np.array([(3, 6), (8, 12), (20, 34)])]) == bytes([9, 6, 12, 18, 10, 12, 24, 44, 15])


def test_varints_of_any_size():
    values = [0, 1, 127, 128, 300, 2**14, 2**21 - 1, 2**21, 2**35, 2**62, 2**63, 2**64 - 1]
    assert mvt.varints(np.array(values, np.uint64)) == b"".join(mvt.varint(v) for v in values)
    assert mvt.numbers(mvt.varints(np.array(values, np.uint64))) == values


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_merging_in_any_order_gives_the_same_bytes(parts):
    given = features(120, seed=parts)
    held = defaultdict(mvt.Partial)
    for order, f in enumerate(given):
        held[order * 31 % parts].add(order, f["id"], f["kind"], f["geom"], f["props"])
    merged = mvt.Partial()
    for k in reversed(range(parts)):
        merged.merge(list(held[k].keys), list(held[k].values), iter(held[k].features))
    assert merged.message("x", 4096) == mvt.layer("x", given, 4096)


def test_tiles_do_not_depend_on_the_partitions(spark):
    d = "/root/testdata/sf0.001"
    given = vector.to_metres(views.point_features(spark, d).unionByName(views.box_features(spark, d)), "4326")
    cut = tileset.feature_tiles(given, MvtOptions(0, 2)).cache()
    tiles = {}
    for n in (1, 5):
        partials = tileset.partial_layers(cut.repartition(n, F.rand(n)))
        tiles[n] = {(r["z"], r["x"], r["y"]): bytes(r["data"]) for r in tileset.merged_tiles(partials).collect()}
    assert tiles[1] == tiles[5]
    data = gzip.decompress(tiles[1][0, 0, 0])
    assert [(x["name"], len(x["features"])) for x in mvt.decode(data)] == [("pts", 150), ("boxes", 10)]
    cut.unpersist()


def test_a_hot_tile_is_encoded_by_many_tasks(spark):
    points = spark.range(0, 20_000, 1, 8).select(F.lit("p").alias("layer"), F.lit(0).alias("layer_ord"), F.col("id").alias("feature_ord"), F.lit("Point").alias("kind"), F.array(F.array(F.struct(F.col("id") % 4096, F.col("id") % 97).cast("struct<x:bigint,y:bigint>"))).alias("geom"), F.col("id").cast("decimal(20,0)").alias("id"), F.lit(None).cast(vector.PROP).alias("props"), F.lit(3).alias("z"), F.lit(1).cast("long").alias("x"), F.lit(2).cast("long").alias("y"))
    partials = tileset.partial_layers(points)
    held = [r["n"] for r in partials.select(F.size("orders").alias("n")).collect()]
    assert sum(held) == 20_000 and len(held) >= 8 and max(held) <= 10_000
    (tile,) = tileset.merged_tiles(partials, MvtOptions(compress=False)).collect()
    (layer,) = mvt.decode(tile["data"])
    assert [f["id"] for f in layer["features"]] == list(range(20_000)) and layer["features"][5000]["geom"] == [[(904, 53)]]


def test_decoded_tileset(spark):
    tile = mvt.tile([("a", features(3)), ("b", features(2, seed=9))], 4096)
    tiles = spark.createDataFrame([(1, 0, 1, tile), (1, 1, 1, gzip.compress(tile)), (1, 1, 0, b"")], "z int, x long, y long, data binary")
    got = tileset.decoded(tiles).groupBy("x", "y", "layer").count().collect()
    assert sorted(map(tuple, got)) == [(0, 1, "a", 3), (0, 1, "b", 2), (1, 1, "a", 3), (1, 1, "b", 2)]


def test_a_merged_layer_has_the_bytes_of_the_object_form(monkeypatch):
    rng, whole, rows = np.random.default_rng(3), mvt.Partial(), []
    monkeypatch.setattr(mvt, "PIECE", 7)
    for _ in range(9):
        part = mvt.Partial()
        for _ in range(rng.integers(1, 12)):
            order = int(rng.integers(0, 1 << 40))
            props = [{"k": f"k{rng.integers(0, 4)}", "t": "Int", "i": int(v), "b": None, "d": None, "s": None} for v in rng.integers(-300, 300, rng.integers(0, 4))]
            props += [{"k": "text", "t": "String", "s": "é" * int(rng.integers(0, 90)), "b": None, "i": None, "d": None}] * int(rng.integers(0, 2))
            part.add(order, int(rng.integers(0, 1 << 62)) if rng.random() < 0.7 else None, "LineString", [rng.integers(-64, 4160, (int(rng.integers(2, 60)), 2))], props)
        whole.merge(list(part.keys), list(part.values), iter(part.features))
        rows.append(((0, 0, 0, 0, "roads"), part))
    table = pa.Table.from_batches([tileset.partial_batch({place: part}) for place, part in rows])
    assert mvt.merged_layer("roads", table, 4096) == whole.message("roads", 4096)


def test_features_are_decoded_one_by_one():
    found, features = next(mvt.read_layers(mvt.tile([("pts", [{"id": k, "kind": "Point", "geom": [np.array([[k, k]])], "props": []} for k in range(50)])], 4096)))
    assert found == {"name": "pts", "extent": 4096, "version": 2} and iter(features) is features
    assert [f["id"] for f in features] == list(range(50))
