"""GeoJSON by byte ranges: a feature collection of any size, on one line or many, read by many tasks.

Whether a byte lies within a string, and how deep, depends on all bytes before it. So three passes of
independent tasks read the ranges of a file:

1. each range tells whether it holds an odd number of quotes that aren't escaped, and by how much
   brackets outside strings change the depth, for either case of beginning outside or inside one;
   combined in order (a row a range), these give the state in which each range begins;
2. with it, each range looks for the array under the root's key ``features`` and for where it ends;
3. each range gives the features that begin in it, reading on to the end of the last.

A task holds a range and the feature that crosses its end. A file without such an array (a single
feature or geometry) is one record and is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector
from .ranges import RangeFile

RANGE_BYTES = 8 << 20
#: Bytes before a bracket that may hold its key.
KEY_BYTES = 256
FEATURES = re.compile(rb'"features"\s*:\s*$')
QUOTE, BACKSLASH, OPEN, CLOSE = 34, 92, (91, 123), (93, 125)

#: What each byte does to the depth outside strings.
STEP = np.zeros(256, np.int8)
STEP[list(OPEN)], STEP[list(CLOSE)] = 1, -1


def quotes_of(data: np.ndarray) -> np.ndarray:
    """Places of quotes that aren't escaped, in bytes that begin with no escape pending."""
    at = np.flatnonzero(data == QUOTE)
    if not len(at) or not (data == BACKSLASH).any():
        return at
    plain = np.maximum.accumulate(np.where(data != BACKSLASH, np.arange(len(data)), -1))
    before = np.where(at > 0, plain[at - 1], -1)
    return at[(at - 1 - before) % 2 == 0]


def read_range(source: RangeFile, start: int, end: int) -> np.ndarray:
    """Bytes of a range; a quote at its begin that is escaped is blanked."""
    data = np.frombuffer(source(start, end - start), np.uint8)
    back, n = 0, 64
    while start and len(data) and data[0] == QUOTE:
        before = source(max(0, start - n), min(n, start))
        back = len(before) - len(before.rstrip(b"\\"))
        if back < len(before) or len(before) == start:
            break
        n *= 8
    if start and len(data) and data[0] == BACKSLASH:  # an escape that began before the range ends with its first byte
        before = source(max(0, start - 4096), min(4096, start))
        back = len(before) - len(before.rstrip(b"\\"))
    if back % 2:
        data = data.copy()
        data[0] = 32
    return data


def structure(data: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of brackets outside strings, depth after each)."""
    odd = np.zeros(len(data), bool)
    odd[quotes_of(data)] = True
    within = np.logical_xor.accumulate(odd) ^ inside if len(data) else odd
    at = np.flatnonzero((STEP[data] != 0) & ~within)
    return at, depth + np.cumsum(STEP[data[at]], dtype=np.int64)


def ranges(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One row a task."""
    return spark.createDataFrame(rows, schema).repartitionByRange(len(rows), "start") if len(rows) > 1 else spark.createDataFrame(rows, schema)


def begins(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[tuple[int, int, bool, int]]:
    """(start, end, within a string, depth) of each range."""
    size = RangeFile(path).size()
    cuts = [(a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = RangeFile(path)
        for batch in batches:
            out = []
            for start, end in zip(*(batch.column(c).to_pylist() for c in ("start", "end"))):
                data = read_range(source, start, end)
                quotes = quotes_of(data)
                outside, inside = (int(d[-1]) if len(d) else 0 for _, d in (structure(data, s, 0) for s in (False, True)))
                out.append((start, end, len(quotes) % 2 == 1, outside, inside))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["start", "end", "odd", "outside", "inside"])

    found, within, depth = [], False, 0
    if not cuts:
        return []
    seen = ranges(spark, cuts, "start long, end long").mapInArrow(look, "start long, end long, odd boolean, outside long, inside long")
    for r in seen.orderBy("start").toLocalIterator():
        found.append((r["start"], r["end"], within, depth))
        depth += r["inside"] if within else r["outside"]
        within ^= r["odd"]
    return found


def features_span(spark: SparkSession, path: str, starts: list[tuple[int, int, bool, int]]) -> tuple[int, int] | None:
    """Where the root's array of features opens and closes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = RangeFile(path)
        for batch in batches:
            out = []
            for start, end, within, depth in zip(*(batch.column(c).to_pylist() for c in ("start", "end", "within", "depth"))):
                data = read_range(source, start, end)
                at, after = structure(data, within, depth)
                opened = closed_after = None
                for k in np.flatnonzero((data[at] == OPEN[0]) & (after == 2)):
                    place = start + int(at[k])
                    before = source(max(0, place - KEY_BYTES), min(KEY_BYTES, place))
                    if FEATURES.search(before):
                        opened = place
                        later = np.flatnonzero((after[k:] == 1))
                        closed_after = start + int(at[k + later[0]]) if len(later) else None
                        break
                first = np.flatnonzero((after == 1) & (STEP[data[at]] < 0))
                out.append((start, opened, closed_after, start + int(at[first[0]]) if len(first) else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["start", "opened", "closed_after", "first_close"])

    opened = None
    for r in ranges(spark, starts, "start long, end long, within boolean, depth long").mapInArrow(look, "start long, opened long, closed_after long, first_close long").orderBy("start").toLocalIterator():
        if opened is None:
            opened, closed = r["opened"], r["closed_after"]
        else:
            closed = r["first_close"]
        if opened is not None and closed is not None:
            return opened, closed
    return None


def feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(feature_ord, text) of each record; the order is the place of its first byte."""
    starts = begins(spark, path, range_bytes)
    span = features_span(spark, path, starts) if starts else None
    if span is None:
        return spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("feature_ord"), F.col("value").alias("text")).where(F.rlike("text", F.lit(r"\S")))
    opened, closed = span

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = RangeFile(path)
        for batch in batches:
            for start, end, within, depth in zip(*(batch.column(c).to_pylist() for c in ("start", "end", "within", "depth"))):
                data = read_range(source, start, end)
                at, after = structure(data, within, depth)
                here = (start + at > opened) & (start + at < closed)
                firsts = at[here & (after == 3) & (data[at] == OPEN[1])]
                lasts = at[here & (after == 2) & (data[at] == CLOSE[1])]
                lasts = lasts[np.searchsorted(lasts, firsts[0]) :] if len(firsts) else lasts[:0]
                held = data.tobytes()
                places, texts = [start + int(a) for a in firsts], [held[a : b + 1] for a, b in zip(firsts, lasts)]
                if len(lasts) < len(firsts):
                    texts.append(rest(source, held[firsts[-1] :], end, max(len(held), 1 << 16), closed))
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], ["feature_ord", "text"])

    inside = [s for s in starts if s[1] > opened and s[0] <= closed]
    return ranges(spark, inside, "start long, end long, within boolean, depth long").mapInArrow(cut, "feature_ord long, text string")


def rest(source: RangeFile, text: bytes, at: int, step: int, closed: int) -> bytes:
    """A feature that begins with ``text`` and goes on at byte ``at``: as much more, twice as much each time, as it takes."""
    while at < closed:
        text += source(at, min(step, closed - at))
        at += min(step, closed - at)
        step *= 2
        places, after = structure(np.frombuffer(text, np.uint8), False, 0)
        if len(end := np.flatnonzero(after == 0)):
            return text[: places[end[0]] + 1]
    raise ValueError("a feature does not end")


def scan(spark: SparkSession, path: str, layer: str, layer_ord: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Features of a file read by range, in order; those without a geometry go."""
    from .readers import features_of

    return features_of(feature_texts(spark, path, range_bytes), layer, layer_ord)
