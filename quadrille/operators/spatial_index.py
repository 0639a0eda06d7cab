"""Points in areas, through a quadtree that splits where points are dense and a packed R-tree in each task.

1. Points are counted by cell of a fine grid, and counts are added up cell by parent cell. A cell with at
   most its share of all points (one in ``parts``), whose parent has more, is a leaf; a finest cell that
   still holds more is dealt into as many parts as it has shares. So no task gets more points than a share,
   and there are at most about ``4 * depth * parts`` leaves, whatever the number of points: the driver
   may hold them, and tasks look them up.
2. An area descends from the root into the leaves that its box meets. A leaf that a rectangle covers gives
   its count at once; the others send the area to the leaf's points. Areas of a leaf are dealt into parts
   of a counted size too.
3. Where points and areas of a leaf meet, the points are sorted along a Hilbert curve and packed into a
   tree of boxes, down which each area goes; points left are tested exactly.

Cells are those of tiles: the square of Web Mercator. Points beyond it, and points without a coordinate,
lie in no area. Edges belong to rectangles; a ring holds what an even-odd count of its edges says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mercator import ORIGIN_SHIFT_M
from ..plans.shared import materialised

DEPTH = 14
PARTS = 64
FAN = 16


@dataclass(frozen=True)
class Quadtree:
    """Leaves by their first finest cell on the Z-curve, and the cells above them, level by level."""

    depth: int
    share: int
    starts: np.ndarray
    levels: np.ndarray
    counts: np.ndarray
    #: Sorted cells of each level that are split.
    split: list[np.ndarray]

    def leaf_of(self, code: np.ndarray) -> np.ndarray:
        """The leaf that holds a finest cell, -1 if none does."""
        if not len(self.starts):
            return np.full(len(code), -1)
        at = np.searchsorted(self.starts, code, "right") - 1
        held = (at >= 0) & (code - self.starts[at] < np.int64(1) << 2 * (self.depth - self.levels[at]))
        return np.where(held, at, -1)

    def salts(self) -> np.ndarray:
        """Parts of each leaf's points: more than one where a finest cell holds more than a share."""
        return np.maximum(1, -(-self.counts // self.share))


def z_code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places on the Z-curve of cells."""
    def spread(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.int64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | v << shift) & mask
        return v

    return spread(x) | spread(y) << 1


def cell(v: np.ndarray, depth: int) -> np.ndarray:
    """Columns of cells from metres east, or rows from metres south."""
    side = 1 << depth
    return np.clip(np.floor((v + ORIGIN_SHIFT_M) / (2 * ORIGIN_SHIFT_M) * side), 0, side - 1).astype(np.int64)


def located(points: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(id, x, y, code) of the points within the square."""
    inside = F.abs("x") <= ORIGIN_SHIFT_M, F.abs("y") <= ORIGIN_SHIFT_M

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in "xy")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z_code(cell(x, depth), cell(-y, depth)))], ["id", "x", "y", "code"])

    kept = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(inside[0] & inside[1])
    return kept.mapInArrow(code, "id long, x double, y double, code long")


def build(points: DataFrame, parts: int = PARTS, depth: int = DEPTH) -> Quadtree:
    """The quadtree of located points. Cells below one that is no share are never brought to the driver."""
    finest = materialised(points.groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    total = finest.agg(F.sum("n")).first()[0] or 0
    share = max(1, -(-total // parts))
    above, leaves, split = {0}, [], []
    for level in range(depth + 1):
        up = 2 * (depth - level)
        counts = finest.groupBy(F.shiftright("code", up).alias("c")).agg(F.sum("n").alias("n"))
        parents = F.shiftright("code", up + 2) if level else None
        if level:  # only children of cells that are split
            kept = finest.join(F.broadcast(finest.sparkSession.createDataFrame([(int(c),) for c in sorted(above)], "p long")), parents == F.col("p"), "left_semi")
            counts = kept.groupBy(F.shiftright("code", up).alias("c")).agg(F.sum("n").alias("n"))
        rows = counts.collect()  # at most four a cell that is split, of which a level has ``parts`` at most
        dense = {r["c"] for r in rows if r["n"] > share and level < depth}
        leaves += [(r["c"] << up, level, r["n"]) for r in rows if r["c"] not in dense]
        split.append(np.array(sorted(dense), np.int64))
        above = dense
        if not dense:
            break
    starts, levels, counts = np.array(sorted(leaves), np.int64).reshape(-1, 3).T
    return Quadtree(depth, share, starts, levels, counts, split)


def met_leaves(tree: Quadtree, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(leaves that a box meets, whether it covers each), by descent from the root."""
    x0, y0, x1, y1 = box
    if not (x0 <= x1 and y0 <= y1) or x1 < -ORIGIN_SHIFT_M or y1 < -ORIGIN_SHIFT_M or x0 > ORIGIN_SHIFT_M or y0 > ORIGIN_SHIFT_M:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    found, covered = [], []
    cx, cy = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(tree.depth + 1):
        size = 2 * ORIGIN_SHIFT_M / (1 << level)
        west, north = cx * size - ORIGIN_SHIFT_M, ORIGIN_SHIFT_M - cy * size
        slack = size * 1e-9  # cells are cut by rounded numbers; a leaf met for nothing costs a test, one missed a point
        meets = (west <= x1 + slack) & (west + size >= x0 - slack) & (north >= y0 - slack) & (north - size <= y1 + slack)
        cx, cy, west, north = cx[meets], cy[meets], west[meets], north[meets]
        codes = z_code(cx, cy)
        held = np.isin(codes, tree.split[level]) if level < len(tree.split) else np.zeros(len(codes), bool)
        leaf = tree.leaf_of(codes << 2 * (tree.depth - level))
        mine = ~held & (leaf >= 0)
        mine[mine] = tree.levels[leaf[mine]] == level
        found.append(leaf[mine])
        covered.append(((west - slack >= x0) & (west + size + slack <= x1) & (north + slack <= y1) & (north - size - slack >= y0))[mine])
        cx, cy = cx[held], cy[held]
        if not len(cx):
            break
        cx, cy = (np.concatenate([2 * cx, 2 * cx + 1, 2 * cx, 2 * cx + 1]), np.concatenate([2 * cy, 2 * cy, 2 * cy + 1, 2 * cy + 1]))
    return np.concatenate(found), np.concatenate(covered)


def hilbert(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """Places on the Hilbert curve of whole numbers below 2 ** bits."""
    x, y, out = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    for k in range(bits - 1, -1, -1):
        rx, ry = x >> k & 1, y >> k & 1
        out += (3 * rx ^ ry) << 2 * k
        low = (1 << k) - 1
        x, y = x & low, y & low
        turned, flipped = ry == 0, (ry == 0) & (rx == 1)
        x, y = np.where(flipped, low - x, x), np.where(flipped, low - y, y)
        x, y = np.where(turned, y, x), np.where(turned, x, y)
    return out


class PackedTree:
    """Points in the order of a Hilbert curve, and boxes of ``FAN`` points, of ``FAN`` boxes and so on."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        reach = max(np.ptp(x), np.ptp(y), 1e-300) if len(x) else 1.0
        order = np.argsort(hilbert(*(((v - v.min()) / reach * 65535) for v in (x, y))), kind="stable") if len(x) else np.zeros(0, np.int64)
        self.x, self.y = x[order], y[order]
        self.levels = []
        low_x = high_x = self.x
        low_y = high_y = self.y
        while len(low_x):
            at = np.arange(0, len(low_x), FAN)
            low_x, low_y, high_x, high_y = np.minimum.reduceat(low_x, at), np.minimum.reduceat(low_y, at), np.maximum.reduceat(high_x, at), np.maximum.reduceat(high_y, at)
            self.levels.append((low_x, low_y, high_x, high_y))
            if len(at) == 1:
                break

    def within(self, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
        """Places of the points in a rectangle, edges included."""
        if not self.levels:
            return np.zeros(0, np.int64)
        nodes = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            low_x, low_y, high_x, high_y = (c[nodes] for c in self.levels[k])
            nodes = nodes[(low_x <= x1) & (high_x >= x0) & (low_y <= y1) & (high_y >= y0)]
            size = len(self.levels[k - 1][0]) if k else len(self.x)
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[nodes < size]
        px, py = self.x[nodes], self.y[nodes]
        return nodes[(px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)]


def in_rings(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Whether an odd number of edges lies east of each point."""
    inside = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
            if ay != by:
                crosses = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
                inside ^= crosses
    return inside


def points_within(points: DataFrame, areas: DataFrame, parts: int = PARTS, depth: int = DEPTH) -> DataFrame:
    """(k, n): how many of ``points`` (id, x, y) each area holds, where it holds any. ``areas``: k, min_x, min_y,
    max_x, max_y and, for other shapes than rectangles, ``parts`` as features have them (all their rings)."""
    spark = points.sparkSession
    placed = materialised(located(points, depth))
    tree = build(placed, parts, depth)
    salts, counts = tree.salts(), tree.counts
    ringed = "parts" in areas.columns
    boxes = areas.select("k", *[F.col(c).cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")], *(["parts"] if ringed else []))
    rings_type = boxes.schema["parts"].dataType.simpleString() if ringed else None
    key = boxes.schema["k"].dataType.simpleString()

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("min_x", "min_y", "max_x", "max_y")]
            rows, leaves, whole = [], [], []
            for row, box in enumerate(zip(*columns)):
                leaf, covers = met_leaves(tree, box)
                rows.append(np.full(len(leaf), row))
                leaves.append(leaf)
                whole.append(covers if not ringed else np.zeros(len(leaf), bool))
            row, leaf, covers = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, leaves, whole))
            taken = batch.take(pa.array(row.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf.astype(np.int64)), pa.array(np.where(covers, counts[leaf.astype(np.int64)], 0).astype(np.int64)), pa.array(covers.astype(bool))], [*taken.schema.names, "leaf", "n", "covers"])

    schema = f"k {key}, min_x double, min_y double, max_x double, max_y double" + (f", parts {rings_type}" if ringed else "") + ", leaf long, n long, covers boolean"
    met = materialised(boxes.mapInArrow(descend, schema))
    # parts of a leaf's areas, as large as a share of all meetings
    here = met.where("not covers").groupBy("leaf").agg(F.count(F.lit(1)).alias("m"))
    many = here.agg(F.sum("m")).first()[0] or 0
    most = max(1, -(-many // parts))
    piles = {r["leaf"]: -(-r["m"] // most) for r in here.where(F.col("m") > most).collect()}  # ``parts`` leaves at most
    pile = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in piles.items() for v in kv]), F.col("leaf").cast("int")), F.lit(1)) if piles else F.lit(1)
    split = {i: int(s) for i, s in enumerate(salts) if s > 1}
    salt = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in split.items() for v in kv]), F.col("leaf").cast("int")), F.lit(1)) if split else F.lit(1)

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "x", "y")), pa.array(tree.leaf_of(batch.column("code").to_numpy()))], ["id", "x", "y", "leaf"])

    own = placed.mapInArrow(leaf_of, "id long, x double, y double, leaf long").join(F.broadcast(here.select("leaf")) if len(counts) <= 200_000 else here.select("leaf"), "leaf", "left_semi")
    own = own.withColumn("salt", F.pmod(F.xxhash64("id", "x", "y"), salt).cast("int")).withColumn("pile", F.explode(F.sequence(F.lit(0), pile - 1)))
    asked = met.where("not covers").drop("n", "covers").withColumn("pile", F.pmod(F.xxhash64("k", "min_x", "min_y", "max_x", "max_y"), pile).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), salt - 1)))

    def meet(some: pa.Table, asking: pa.Table) -> pa.Table:
        packed, found = PackedTree(*(some.column(c).to_numpy() for c in "xy")), []
        boxes_ = zip(*(asking.column(c).to_pylist() for c in ("min_x", "min_y", "max_x", "max_y")))
        for box, shape in zip(boxes_, asking.column("parts") if ringed else [None] * len(asking)):
            at = packed.within(*box)
            if ringed and len(at):
                rings = [np.array([(p["x"], p["y"]) for p in ring]) for part in shape.as_py() for ring in part]
                at = at[in_rings(packed.x[at], packed.y[at], rings)]
            found.append(len(at))
        return pa.table({"k": asking.column("k"), "n": pa.array(found, pa.int64())})

    place = ["leaf", "salt", "pile"]
    tested = own.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(meet, f"k {key}, n long")
    return met.where("covers").select("k", "n").unionByName(tested).groupBy("k").agg(F.sum("n").alias("n")).where("n > 0")
