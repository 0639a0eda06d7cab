"""One file made by many tasks: rows of bytes, put in order at places counted before.

Rows are sorted, numbered by byte within their partition and written to the shared folder once. A
row's place in the file follows from the bytes of the partitions before its own, so tasks write rows
independently and may be repeated; the driver writes what comes before and after them, checks the
number of bytes and renames the file. Needs a folder that driver and executors share.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.options import TileError
from ..plans.shared import materialised


def in_order(rows: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """The rows sorted and written once, in ``parts`` partitions if given, with ``part``, and ``nth`` and ``at``: the rows, and bytes of ``data``, before them in their partition."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = rows_done = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("data")).to_numpy().astype(np.int64)
            ends = done + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(rows_done, rows_done + len(sizes))), pa.array(ends - sizes)], [*batch.schema.names, "nth", "at"])
            done, rows_done = int(ends[-1]) if len(ends) else done, rows_done + len(sizes)

    ordered = (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts else rows.orderBy(*order)).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + ", nth long, at long"
    return materialised(ordered.mapInArrow(number, schema))


def write_rows(numbered: DataFrame, path: str, head: bytes | Callable[[], bytes] = b"", tail: bytes = b"") -> int:
    """Rows of ``in_order`` as one file, between ``head`` and ``tail``. Returns its bytes."""
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.sum(F.octet_length("data")).alias("n")).collect()}  # a row per partition
    head = head() if callable(head) else head
    starts, end = {}, len(head)
    for part in sorted(sizes):
        starts[part] = end
        end += sizes[part]
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as file:
        file.write(head)
        file.seek(end)
        file.write(tail)
        file.truncate(end + len(tail))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(aside, os.O_WRONLY)
        try:
            for batch in batches:
                n = 0
                for part, at, data in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist(), batch.column("data")):
                    n += os.pwrite(file, data.as_buffer(), starts[part] + at)
                os.fsync(file)
                yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])
        finally:
            os.close(file)

    try:
        written = numbered.select("part", "at", "data").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
        if written != end - len(head):
            raise TileError(f"{written} of {end - len(head)} bytes were written to {path}")
    except BaseException:
        os.unlink(aside)
        raise
    os.replace(aside, path)
    return end + len(tail)


def geojson_text(features: DataFrame) -> DataFrame:
    """(feature_ord, text): each feature as GeoJSON on one line. Coordinates are in the features' own system."""
    pair = lambda p: F.array(p.x, p.y)
    line = lambda r: F.transform(r, pair)
    first = F.get(F.get("parts", F.lit(0)), F.lit(0))
    shape = (
        F.when(F.col("kind") == "Point", F.to_json(pair(F.get(first, F.lit(0))))).when(F.col("kind").isin("MultiPoint", "LineString"), F.to_json(line(first)))
        .when(F.col("kind") == "MultiLineString", F.to_json(F.transform("parts", lambda part: line(F.get(part, F.lit(0)))))).when(F.col("kind") == "Polygon", F.to_json(F.transform(F.get("parts", F.lit(0)), line)))
        .otherwise(F.to_json(F.transform("parts", lambda part: F.transform(part, line)))))
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    value = lambda p: F.coalesce(F.when(p.t == "Bool", p.b.cast("string")).when(p.t == "Int", p.i.cast("string")).when(p.t == "Float", p.d.cast("string")).when(p.t == "String", quoted(p.s)), F.lit("null"))
    props = F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform("props", lambda p: F.concat(quoted(p.k), F.lit(":"), value(p))), ","), F.lit("}")), F.lit("null"))
    ident = F.coalesce(F.concat(F.lit('"id":'), F.col("id").cast("string"), F.lit(",")), F.lit(""))
    return features.select("layer_ord", "feature_ord", F.concat(F.lit('{"type":"Feature",'), ident, F.lit('"geometry":{"type":"'), "kind", F.lit('","coordinates":'), shape, F.lit('},"properties":'), props, F.lit("}")).alias("text"))


def write_geojson(features: DataFrame, path: str) -> int:
    """All features in order as one FeatureCollection on one line, written by many tasks. Returns its bytes."""
    rows = geojson_text(features).select("layer_ord", "feature_ord", F.encode(F.concat("text", F.lit(",")), "utf-8").alias("data"))
    # a last feature without a geometry or a property stands for the comma before it
    return write_rows(in_order(rows, ["layer_ord", "feature_ord"]), path, b'{"type":"FeatureCollection","features":[', b'{"type":"Feature","geometry":null,"properties":null}]}')
