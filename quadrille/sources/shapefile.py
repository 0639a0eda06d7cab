"""Shapefiles by ranges of records, through the offsets of their index file.

The index (``.shx``) has eight bytes a record, so a task finds the bytes of its records without reading
others; rows of the attribute table (``.dbf``) have one length. The driver reads headers alone. Files are
opened by Arrow's file systems.

Defined results: records without a shape and rows marked as deleted go; further dimensions (Z, M) are
left out; a hole belongs to the smallest outer ring that holds its first vertex, and is a polygon of its
own if none does; blank values are Null; dates are ISO text; an id is the record's number, from 0; a
file without records gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector
from ..plans.options import TileError
from .ranges import RangeFile

HEAD, ENTRY, RECORDS = 100, 8, 20_000
#: A core gets so many tasks; ranges beyond them share tasks, which hold RECORDS records at most unless a range does.
TASKS = 4
#: Bytes of shapes that a task holds at a time.
PIECE = 4 << 20
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
PROP = pa.struct([("k", pa.string()), ("t", pa.string()), ("b", pa.bool_()), ("i", pa.int64()), ("d", pa.float64()), ("s", pa.string())])
TYPES = {"feature_ord": pa.int64(), "kind": pa.string(), "parts": pa.list_(pa.list_(pa.list_(POINT))), "props": pa.list_(PROP)}


def vertices(xy: np.ndarray) -> list[dict]:
    return [{"x": x, "y": y} for x, y in xy.tolist()]


def twice_area(ring: np.ndarray) -> float:
    """Above 0 where a ring runs against the clock."""
    x, y = (ring - ring[0]).T
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1])


def holds(ring: np.ndarray, at: np.ndarray) -> bool:
    (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
    crossed = (y0 > at[1]) != (y1 > at[1])
    x = x0[crossed] + (at[1] - y0[crossed]) / (y1[crossed] - y0[crossed]) * (x1[crossed] - x0[crossed])
    return bool((x > at[0]).sum() % 2)


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings as polygons, each an outer ring (clockwise in files) and its holes."""
    areas = [twice_area(r) for r in rings]
    outer = [k for k, a in enumerate(areas) if a <= 0]
    of: dict[int, list[np.ndarray]] = {k: [rings[k]] for k in outer}
    for k, ring in enumerate(rings):
        if areas[k] > 0:
            # a lone outer ring has all holes
            around = outer if len(outer) == 1 else [o for o in outer if holds(rings[o], ring[0])]
            of.setdefault(min(around, key=lambda o: -areas[o], default=k), []).append(ring)
    return list(of.values())


def shape(data: bytes) -> tuple[str, list] | None:
    """(kind, parts) of a record's content."""
    code = struct.unpack_from("<i", data)[0]
    if code == 0:
        return None
    flat = code % 10
    if code > 30 or flat not in (1, 3, 5, 8):
        raise TileError(f"unknown shape type {code}")
    if flat == 1:
        return "Point", [[vertices(np.frombuffer(data, "<f8", 2, 4).reshape(1, 2))]]
    if flat == 8:
        n = struct.unpack_from("<i", data, 36)[0]
        return "MultiPoint", [[vertices(np.frombuffer(data, "<f8", 2 * n, 40).reshape(n, 2))]]
    n_parts, n = struct.unpack_from("<ii", data, 36)
    starts = np.frombuffer(data, "<i4", n_parts, 44).tolist()
    xy = np.frombuffer(data, "<f8", 2 * n, 44 + 4 * n_parts).reshape(n, 2)
    lines = [xy[a:b] for a, b in zip(starts, [*starts[1:], n]) if b > a]
    if not lines:
        return None
    if flat == 3:
        return ("LineString" if len(lines) == 1 else "MultiLineString"), [[vertices(x)] for x in lines]
    found = polygons(lines)
    return ("Polygon" if len(found) == 1 else "MultiPolygon"), [[vertices(r) for r in p] for p in found]


class Attributes:
    """The attribute table: its fields, and its rows by range."""

    def __init__(self, path: str, encoding: str):
        self.file, self.encoding = RangeFile(path), encoding
        self.rows, self.head, self.length = struct.unpack_from("<IHH", self.file(0, 32), 4)
        raw = self.file(32, self.head - 32)
        self.fields, at = [], 1
        for k in range(0, len(raw) - 31, 32):
            if raw[k] == 0x0D:
                break
            name = raw[k : k + 11].split(b"\0")[0].decode(encoding)
            self.fields.append((name, chr(raw[k + 11]), at, raw[k + 16], raw[k + 17]))
            at += raw[k + 16]
        self.fields.sort()

    def read(self, low: int, high: int) -> list[bytes]:
        data = self.file(self.head + low * self.length, (high - low) * self.length)
        return [data[i : i + self.length] for i in range(0, len(data), self.length)]

    def props(self, row: bytes) -> list[dict]:
        return [{"k": name} | self.value(kind, decimals, row[at : at + size]) for name, kind, at, size, decimals in self.fields]

    def value(self, kind: str, decimals: int, raw: bytes) -> dict:
        text = raw.decode(self.encoding, "replace").strip(" \0")
        if kind == "L":
            return {"t": "Bool", "b": text in "YyTt"} if text and text in "YyTtNnFf" else {"t": "Null"}
        if not text or kind in "NF" and text.strip("*") == "":
            return {"t": "Null"}
        if kind in "NF":
            if kind == "N" and not decimals and text.lstrip("+-").isdigit() and -(2**63) <= int(text) < 2**63:
                return {"t": "Int", "i": int(text)}
            try:
                return {"t": "Float", "d": float(text)}
            except ValueError:
                return {"t": "Null"}
        if kind == "D":
            return {"t": "String", "s": f"{text[:4]}-{text[4:6]}-{text[6:8]}"} if len(text) == 8 and text != "00000000" else {"t": "Null"}
        return {"t": "String", "s": text}


def beside(path: str, suffix: str) -> str:
    return path[: -len(".shp")] + suffix if path.lower().endswith(".shp") else path + suffix


def pages(index: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of records whose bytes are PIECE at most, or one record."""
    low, held = 0, 0
    for k, size in enumerate(index[:, 1].tolist()):
        if k > low and held + size > PIECE:
            yield low, k
            low, held = k, 0
        held += size
    if len(index):
        yield low, len(index)


def records(shapes: RangeFile, index_file: RangeFile, table: Attributes, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The features of records low to high."""
    entries = index_file(HEAD + low * ENTRY, (high - low) * ENTRY)
    # places and lengths, of headers and contents, in bytes
    index = np.frombuffer(entries, ">i4").reshape(-1, 2).astype(np.int64) * 2 + np.array([0, 8])
    for a, b in pages(index):
        start, end = int(index[a:b, 0].min()), int(index[a:b].sum(1).max())
        packed = end - start <= 2 * PIECE + int(index[a:b, 1].sum())
        block = shapes(start, end - start) if packed else b""
        out = []
        for k, row in zip(range(a, b), table.read(low + a, low + b)):
            at, size = index[k].tolist()
            content = block[at - start + 8 : at - start + size] if packed else shapes(at, size)[8:]
            if row[:1] != b"*" and (found := shape(content)):
                out.append((low + k, *found, table.props(row)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES.values())], list(TYPES))


def scan(spark: SparkSession, path: str, layer: str, layer_ord: int = 0, rows: int = RECORDS, encoding: str | None = None) -> DataFrame:
    """Features in order of record; ``rows`` records are read at a time, by a task of their own while there are few. The encoding is that of the ``.cpg`` file, else Latin-1."""
    try:
        n = (RangeFile(beside(path, ".shx")).size() - HEAD) // ENTRY
        table = Attributes(beside(path, ".dbf"), encoding or "latin-1")
    except FileNotFoundError as e:
        raise TileError(f"no index or table beside {path}") from e
    if n != table.rows:
        raise TileError(f"{n} shapes and {table.rows} rows in {path}")
    if not encoding:
        try:
            encoding = RangeFile(beside(path, ".cpg"))(0, 32).decode("ascii").strip() or "latin-1"
        except FileNotFoundError:
            encoding = "latin-1"
    parts = max(1, -(-n // rows))
    tasks = min(parts, max(TASKS * spark.sparkContext.defaultParallelism, -(-n // max(rows, RECORDS))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, index_file, attributes = RangeFile(path), RangeFile(beside(path, ".shx")), Attributes(beside(path, ".dbf"), encoding)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield from records(shapes, index_file, attributes, k * rows, min(n, (k + 1) * rows))

    found = spark.range(0, parts, 1, tasks).mapInArrow(read, f"feature_ord long, kind string, parts {vector.PARTS}, props {vector.PROP}")
    return found.select(F.lit(layer).alias("layer"), F.lit(layer_ord).alias("layer_ord"), "feature_ord", "kind", "parts", F.col("feature_ord").cast("decimal(20,0)").alias("id"), "props")
