"""Tables of SQLite files (GeoPackage, MBTiles) by ranges of row ids.

The driver asks a file for the least and greatest row id alone, and each task opens the file and reads a
range, which a table's own B-tree finds at once. Needs a path that driver and executors share; a file
in any other store is fetched by Spark as one row and read from memory, in one task.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, MOST_RANGES = 50_000, 10_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local(path: str) -> str | None:
    """The path of a file in the file system, None for one elsewhere."""
    plain = path.removeprefix("file://")
    return plain if "://" not in plain and os.path.isfile(plain) else None


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def asked(spark: SparkSession, path: str, ask: Callable[[sqlite3.Connection], list[tuple]], names: str) -> list[tuple]:
    """A few rows of a file, for the driver."""
    if plain := local(path):
        db = opened(plain)
        try:
            return ask(db)
        finally:
            db.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                if rows := ask(held(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], [n.split()[0] for n in names.split(", ")])

    return [tuple(r) for r in spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, names).collect()]


def held(content: bytes) -> sqlite3.Connection:
    """A database held in memory."""
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def table_rows(spark: SparkSession, path: str, table: str, read: Callable[[sqlite3.Connection, int, int], Iterator[pa.RecordBatch]], schema: str, rows: int = ROWS) -> DataFrame:
    """What ``read(db, least, greatest)`` gives for every range of row ids of a table."""
    plain = local(path)
    if not plain:
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content"):
                    yield from read(held(content.as_py()), -(2**63), 2**63 - 1)

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, schema)
    ((low, high),) = asked(spark, path, lambda db: db.execute(f"select min(rowid), max(rowid) from {quoted(table)}").fetchall(), "")
    step = max(rows, -(-((high or 0) - (low or 0) + 1) // MOST_RANGES))
    starts = [] if low is None else [(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
    spans = spark.createDataFrame(starts, "low long, high long")
    if len(starts) > 1:
        spans = spans.repartitionByRange(len(starts), F.col("low"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()):
                db = opened(plain)
                try:
                    yield from read(db, a, b)
                finally:
                    db.close()

    return spans.mapInArrow(ranges, schema)
