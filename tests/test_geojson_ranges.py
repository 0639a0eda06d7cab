"""GeoJSON by byte ranges, with borders anywhere."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.plans import views
from quadrille.sinks import files
from quadrille.sources import geojson, readers

HARD = {
    "type": "FeatureCollection", "bbox": [1, 2, 3, 4], "crs": {"properties": {"features": [{"no": "feature"}], "name": "x"}}, "others": [{"type": "Feature", "no": {"deep": [1]}}], "note": "\"features\":[{",
    "features": [
        {"type": "Feature", "id": 1, "geometry": {"type": "Point", "coordinates": [1.5, -2]}, "properties": {"name": "plain", "n": 1}},
        {"type": "Feature", "id": "2", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {"name": "quote \" brace } { ] [ and \\", "back": "\\\\\\\"", "n": "1"}},
        {"type": "Feature", "geometry": None, "properties": None},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}, "properties": {"features": [{"a": {"b": "}]"}}], "é☃": "\U0001f600", "ok": True, "none": None}},
        {"type": "Feature", "id": 5, "geometry": {"type": "LineString", "coordinates": [[k, -k] for k in range(60)]}, "properties": {}},
    ],
    "after": [{"type": "Feature"}],
}
ONE_LINE, MANY_LINES = json.dumps(HARD, ensure_ascii=False), json.dumps(HARD, indent=2)


def told(df):
    return [tuple(r) for r in df.orderBy("feature_ord").select("kind", "parts", "id", "props").collect()]


@pytest.mark.parametrize("text, size", [(ONE_LINE, 97), (ONE_LINE, 1 << 20), (MANY_LINES, 211)], ids=["one line", "one range", "many lines"])
def test_ranges_find_every_feature(spark, tmp_path, text, size):
    path = str(tmp_path / "x.geojson")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    assert told(geojson.scan(spark, path, "x", range_bytes=size)) == told(readers.read_geojson(spark, path, "x"))
    texts = geojson.feature_texts(spark, path, size).orderBy("feature_ord").collect()
    assert [json.loads(r["text"]) for r in texts] == HARD["features"]


def test_state_at_every_byte():
    """Each byte as the begin of a range, against reading from the start."""
    data = np.frombuffer(ONE_LINE.encode(), np.uint8)

    class Held:
        def __call__(self, at, n):
            return data[at : at + n].tobytes()

    within, depth, escaped = False, 0, False
    for k, byte in enumerate(data.tolist()):
        places, after = geojson.structure(geojson.read_range(Held(), k, len(data)), within, depth)
        assert len(after) == 0 or after[-1] == 0
        if within:
            if escaped:
                escaped = False
            elif byte == 92:
                escaped = True
            elif byte == 34:
                within = False
        elif byte == 34:
            within = True
        else:
            depth += int(geojson.STEP[byte])


@pytest.mark.parametrize("text, n", [('{"type":"Point","coordinates":[1,2]}', 1), ('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":1}}', 1), ('{"type":"FeatureCollection","features":[]}', 0), ("", 0), (" \n", 0)])
def test_files_without_many_features(spark, tmp_path, text, n):
    (tmp_path / "x.json").write_text(text)
    assert geojson.scan(spark, str(tmp_path / "x.json"), "x", range_bytes=16).count() == n


def test_one_line_is_work_for_many_tasks(spark, tmp_path):
    path = str(tmp_path / "p.geojson")
    given = views.point_features(spark, "/root/testdata/sf0.001")
    files.write_geojson(given, path)
    with open(path) as f:
        text = f.read()
    assert "\n" not in text and len(json.loads(text)["features"]) == 151
    tasks = geojson.feature_texts(spark, path, 1000).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= len(text) // 1000
    back = geojson.scan(spark, path, "pts", range_bytes=1000)
    assert told(back) == told(given)


def test_written_kinds_come_back(spark, tmp_path):
    path, again = str(tmp_path / "a.geojson"), str(tmp_path / "b.geojson")
    shapes = {"Point": [1.5, 2.0], "MultiPoint": [[1.0, 2.0], [3.0, 4.0]], "LineString": [[1.0, 2.0], [3.0, 4.0]], "MultiLineString": [[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]], "Polygon": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], "MultiPolygon": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]}
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": [{"type": "Feature", "id": k, "geometry": {"type": kind, "coordinates": c}, "properties": {"s": "a\"b\\c\né", "i": -3, "d": 0.25, "t": False, "z": None}} for k, (kind, c) in enumerate(shapes.items())]}, f)
    given = geojson.scan(spark, path, "x", range_bytes=200)
    files.write_geojson(given, again)
    assert told(geojson.scan(spark, again, "x", range_bytes=200)) == told(given)
    with open(again) as f:
        assert [(x["geometry"]["type"], x["geometry"]["coordinates"]) for x in json.load(f)["features"][:-1]] == list(shapes.items())
