"""Tile binning of streams of points, which works the same on batches, and pyramids that follow a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import mercator as M


def binned(points: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Points (lon, lat, ...) with the tile that holds them at each zoom."""
    at = points.withColumns({"mx": M.mercator_x("lon"), "my": M.mercator_y("lat")}).withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    return at.withColumns({"x": M.tile_x("z", "mx"), "y": M.tile_y("z", "my")})


def windowed_counts(points: DataFrame, min_zoom: int, max_zoom: int, window: str, late: str) -> DataFrame:
    """Points per tile and window of ``ts``; later than ``late`` behind the newest is left out of a stream."""
    return binned(points.withWatermark("ts", late), min_zoom, max_zoom).groupBy(F.window("ts", window).alias("w"), "z", "x", "y").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "z", "x", "y", "n")


PARTIAL = "z int, x long, y long, total double, n long, ts timestamp"


def partials(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(z, x, y, total, n, ts) of cells (lon, lat, value, ts): sums and counts of a tile and all tiles above it.

    Each Arrow batch is summed at the deepest zoom and rolled up before the shuffle, so the tile at the
    top gets a row a batch and not a row a cell.
    """
    deepest = binned(cells.where("value is not null"), high, high).select("x", "y", F.col("value").cast("double").alias("total"), F.lit(1).cast("long").alias("n"), "ts")
    how = {"total": "sum", "n": "sum", "ts": "max"}

    def roll_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = batch
            for z in range(high, low - 1, -1):
                held = held.groupby(["x", "y"], as_index=False).agg(how)
                yield held.assign(z=z)[["z", "x", "y", "total", "n", "ts"]]
                held = held.assign(x=held["x"] // 2, y=held["y"] // 2)

    return deepest.mapInPandas(roll_up, PARTIAL)


def refreshed(cells: DataFrame, low: int, high: int, quiet_ms: int, late: str) -> DataFrame:
    """A stream of (z, x, y, mean, n): tiles to be made anew, each with the mean of all its cells so far.

    Cells mark their tile and its parents as dirty; a timer of the event time gives a dirty tile out
    once ``quiet_ms`` have passed, however often it has changed since. The newest row of a tile equals
    the batch mean of what was read before it. State is a row a tile. Rows of a batch that are all
    later than ``late`` behind the newest are left out; cells without a value or a place count nowhere.
    """
    state, out = "total double, n long, due long", "z int, x long, y long, mean double, n long"

    def merge(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        total, n, due = held.get if held.exists else (0.0, 0, 0)
        now, fresh = held.getCurrentWatermarkMs(), not held.hasTimedOut
        for frame in frames if fresh else ():
            total, n = total + float(frame["total"].sum()), n + int(frame["n"].sum())
        # no timer of a tile goes off in a batch that changes it, so what is due is looked at here as well
        if not fresh or 0 < due <= now:
            held.update((total, n, 0))
            yield pd.DataFrame([(*key, total / n, n)], columns=["z", "x", "y", "mean", "n"])
        else:
            due = due or now + quiet_ms
            held.update((total, n, due))
            # a timer is gone after each call
            held.setTimeoutTimestamp(max(due, now + 1))

    keyed = partials(cells, low, high).withWatermark("ts", late).groupBy("z", "x", "y")
    return keyed.applyInPandasWithState(merge, out, state, "update", GroupStateTimeout.EventTimeTimeout)
