"""A shapefile written by many tasks: shapes, their index and their attribute table.

Features are encoded, sorted and written to the shared folder once; places in the three files follow from
the bytes and rows of the partitions before (``files.write_rows``). Outer rings run clockwise in the file,
as the format asks, and holes against it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.options import TileError
from ..sources.shapefile import HEAD, RECORDS, beside, twice_area
from . import files

CODES = {"Point": 1, "LineString": 3, "MultiLineString": 3, "Polygon": 5, "MultiPolygon": 5, "MultiPoint": 8}
#: The letter and the width of a field by type of property; texts are as wide as the longest.
FIELDS = {"Bool": ("L", 1), "Int": ("N", 20), "Float": ("F", 24), "String": ("C", None)}
MOST_TEXT, MOST_NAME, MOST_WORDS = 254, 10, 2**31 - 1


def content(kind: str, parts: list) -> bytes:
    """A record's content."""
    array = lambda line: np.array([(p["x"], p["y"]) for p in line], "<f8").reshape(-1, 2)
    code = CODES[kind]
    if code == 1:
        return struct.pack("<i", 1) + array(parts[0][0]).tobytes()
    lines = [(array(ring), k) for part in parts for k, ring in enumerate(part)]
    if code == 5:
        lines = [(r[::-1] if (twice_area(r) > 0) == (k == 0) else r, k) for r, k in lines]
    xy = np.concatenate([x for x, _ in lines])
    head = struct.pack("<i4d", code, *xy.min(0), *xy.max(0))
    if code == 8:
        return head + struct.pack("<i", len(xy)) + xy.tobytes()
    starts = np.cumsum([0, *(len(x) for x, _ in lines[:-1])]).astype("<i4")
    return head + struct.pack("<ii", len(lines), len(xy)) + starts.tobytes() + xy.tobytes()


def fields_of(features: DataFrame) -> list[tuple[str, str, int]]:
    """(name, letter, width) of every property, from one pass; Int and Float make Float, other mixtures are refused."""
    text = F.when(F.col("p.t") == "String", F.octet_length("p.s"))
    seen = features.select(F.explode("props").alias("p")).groupBy("p.k").agg(F.collect_set(F.nullif("p.t", F.lit("Null"))).alias("types"), F.max(text).alias("width")).orderBy("k")
    out = []
    for r in seen.collect():  # a row per field
        kinds = set(r["types"])
        kind = "Float" if kinds == {"Int", "Float"} else kinds.pop() if len(kinds) == 1 else "String" if not kinds else None
        letter, width = FIELDS.get(kind, ("", 0))
        width = width or max(1, r["width"] or 0)
        if not letter or width > MOST_TEXT or not 0 < len(r["k"].encode()) <= MOST_NAME:
            raise TileError(f"property {r['k']!r} of {r['types']} does not fit an attribute table")
        out.append((r["k"], letter, width))
    return out


def attributes(props: list | None, fields: list[tuple[str, str, int]]) -> bytes:
    """A row of the attribute table."""
    held, row = {p["k"]: p for p in props or []}, b" "
    for name, letter, width in fields:
        p = held.get(name) or {"t": "Null"}
        if p["t"] == "Null":
            row += b"?" if letter == "L" else b" " * width
        elif letter == "L":
            row += b"T" if p["b"] else b"F"
        elif letter == "C":
            row += p["s"].encode().ljust(width)
        else:
            row += (str(p["i"]) if p["t"] == "Int" else repr(p["d"])).rjust(width).encode()
    return row


def write_shapefile(features: DataFrame, path: str) -> int:
    """All features in order; they must be of one class (points, many points, lines or areas). Returns the number of records."""
    fields = fields_of(features)
    every = F.flatten(F.flatten("parts"))
    xs, ys = F.transform(every, lambda p: p.x), F.transform(every, lambda p: p.y)
    ends = [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]
    box = features.agg(F.collect_set("kind").alias("kinds"), F.min(ends[0]), F.min(ends[1]), F.max(ends[2]), F.max(ends[3]), F.count(F.lit(1)).alias("rows")).first()
    codes = {CODES.get(k) for k in box["kinds"]}
    if len(codes) > 1 or None in codes:
        raise TileError(f"kinds {box['kinds']} do not fit one shapefile")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            shapes = [content(r["kind"], r["parts"]) for r in rows]
            data = [struct.pack(">ii", 0, len(s) // 2) + s for s in shapes]
            yield pa.RecordBatch.from_arrays([batch.column("layer_ord"), batch.column("feature_ord"), pa.array(data, pa.binary()), pa.array([attributes(r["props"], fields) for r in rows], pa.binary())], ["layer_ord", "feature_ord", "data", "row"])

    kept = features.select(F.col("layer_ord").cast("long").alias("layer_ord"), "feature_ord", "kind", "parts", "props").where(F.size(every) > 0)
    # many features may come from one small file: they are dealt out by number, not by the bytes read
    tasks = -(-box["rows"] // RECORDS)
    dealt = kept.repartition(tasks, "layer_ord", "feature_ord") if tasks > 1 else kept
    numbered = files.in_order(dealt.mapInArrow(encode, "layer_ord long, feature_ord long, data binary, row binary"), ["layer_ord", "feature_ord"], tasks if tasks > 1 else None)
    parts = sorted((r["part"], r["n"], r["size"]) for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("size")).collect())
    before, n, size = {}, 0, HEAD
    for part, rows, taken in parts:
        before[part] = n, size
        n, size = n + rows, size + taken
    if size // 2 > MOST_WORDS:
        raise TileError(f"{size} bytes of shapes do not fit a shapefile")

    def placed(kind: str) -> DataFrame:
        """(part, at, data) of one of the three files."""

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, nth, at = (batch.column(c).to_pylist() for c in ("part", "nth", "at"))
                if kind == "dbf":
                    data = batch.column("row").to_pylist()
                elif kind == "shp":
                    data = [struct.pack(">i", before[p][0] + k + 1) + x[4:] for p, k, x in zip(part, nth, batch.column("data").to_pylist())]
                else:
                    data = [struct.pack(">i", (before[p][1] + a) // 2) + x[4:8] for p, a, x in zip(part, at, batch.column("data").to_pylist())]
                places = at if kind == "shp" else [k * len(data[0]) for k in nth]
                yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(places, pa.int64()), pa.array(data, pa.binary())], ["part", "at", "data"])

        return numbered.mapInArrow(put, "part int, at long, data binary")

    bounds = [v if v is not None else 0.0 for v in box[1:5]]
    head = lambda total: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, total // 2) + struct.pack("<2i8d", 1000, max(codes, default=0), *bounds, 0, 0, 0, 0)
    table = b"".join(name.encode().ljust(11, b"\0") + letter.encode() + bytes(4) + bytes([width, 0]) + bytes(14) for name, letter, width in fields)
    width = 1 + sum(w for _, _, w in fields)
    files.write_rows(placed("dbf"), beside(path, ".dbf"), bytes([3, 100, 1, 1]) + struct.pack("<IHH", n, 33 + len(table), width) + bytes(20) + table + b"\r", b"\x1a")
    files.write_rows(placed("shx"), beside(path, ".shx"), head(HEAD + 8 * n))
    with open(beside(path, ".cpg"), "w") as file:
        file.write("UTF-8")
    files.write_rows(placed("shp"), path, head(size))
    return n
