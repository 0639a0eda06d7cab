"""Vector operators. A feature is (layer, layer_ord, feature_ord, kind, parts, id, props); parts are
polygons > rings > points {x, y}: a line is a polygon of one ring, all points of a multipoint are one ring.
Coordinates are metres once ``to_metres`` has run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..plans.options import MvtOptions, TileError

PARTS = "array<array<array<struct<x:double,y:double>>>>"
PROP = "array<struct<k:string,t:string,b:boolean,i:bigint,d:double,s:string>>"
FEATURE = f"layer string, layer_ord int, feature_ord long, kind string, parts {PARTS}, id decimal(20,0), props {PROP}"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def each_point(parts: Column, use) -> Column:
    return F.transform(parts, lambda poly: F.transform(poly, lambda ring: F.transform(ring, use)))


def points_of(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def with_bbox(features: DataFrame) -> DataFrame:
    """Adds min_x, min_y, max_x, max_y; features without a point go."""
    xs, ys = F.transform(points_of(F.col("parts")), lambda p: p.x), F.transform(points_of(F.col("parts")), lambda p: p.y)
    return features.withColumns({"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}).where("min_x is not null and min_y is not null")


def crs_of_extent(max_x, max_y) -> Column:
    """'4326', '3857' or null, from the largest absolute coordinates; no features are taken as degrees."""
    within = lambda x, y: (F.coalesce(max_x, F.lit(0.0)) <= x) & (F.coalesce(max_y, F.lit(0.0)) <= y)
    return F.when(within(180.5, 90.5), "4326").when(within(M.ORIGIN_SHIFT_M * 1.001, M.ORIGIN_SHIFT_M * 1.001), "3857")


def detect_crs(features: DataFrame) -> DataFrame:
    """(layer, crs) of each layer."""
    boxes = with_bbox(features)
    far = lambda lo, hi: F.max(F.greatest(F.abs(F.col(lo)), F.abs(F.col(hi))))
    return boxes.groupBy("layer").agg(far("min_x", "max_x").alias("ax"), far("min_y", "max_y").alias("ay")).select("layer", crs_of_extent(F.col("ax"), F.col("ay")).alias("crs"))


def to_metres(features: DataFrame, crs: str | None = None) -> DataFrame:
    """Coordinates in metres; without ``crs`` each layer's own, told from its extent. Other kinds of geometry go."""
    kept = features.where(F.col("kind").isin("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"))
    projected = each_point(F.col("parts"), lambda p: F.struct(M.mercator_x(p.x).alias("x"), M.mercator_y(p.y).alias("y")))
    if crs:
        return kept.withColumn("parts", projected) if crs == "4326" else kept
    found = detect_crs(kept)
    unknown = [r["layer"] for r in found.where("crs is null").limit(10).collect()]
    if unknown:
        raise TileError(f"the CRS of these layers can't be told from their extent: {unknown}")
    few = found.limit(20_001).count() <= 20_000
    named = found.withColumnRenamed("layer", "_layer")
    joined = kept.join(F.broadcast(named) if few else named, F.col("layer").eqNullSafe(F.col("_layer")), "left")
    return joined.withColumn("parts", F.when(F.col("crs") == "3857", F.col("parts")).otherwise(projected)).drop("crs", "_layer")


def dataset_bounds(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def feature_id(text: Column) -> Column:
    """An unsigned 64-bit number in text, a plus sign allowed; else null."""
    number = F.when(F.rlike(text, F.lit(r"^\+?0*[0-9]{1,20}$")), F.regexp_replace(text, r"^\+", "").cast("decimal(38,0)"))
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(38,0)"), number.cast("decimal(20,0)"))


def tiles_of(boxes: DataFrame, min_zoom: int, max_zoom: int, buffer: int = 64, extent: int = 4096, most: int = 4096) -> DataFrame:
    """Each box with the tiles (z, x, y) whose buffered rectangle it meets, edges included.

    Tiles are those of the dataset's unbuffered bounds. Candidates are exploded per box, a tile more
    on each side than its own range, and tested exactly; boxes over more than ``most`` candidates
    descend from zoom to zoom instead, through tiles that they meet.
    """
    b = dataset_bounds(boxes).first()
    if b is None or b["min_x"] is None:
        return boxes.where("false").select("*", F.lit(0).alias("z"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    share = buffer / extent
    limits = M.tile_range(F.col("z"), *(F.lit(b[c]) for c in ("min_x", "min_y", "max_x", "max_y")))
    pad = M.span("z") * share
    raw = lambda v: F.floor(v / M.span("z"))
    left, top = F.col("min_x") - pad + M.ORIGIN_SHIFT_M, F.lit(M.ORIGIN_SHIFT_M) - F.col("max_y") - pad
    right, bottom = F.col("max_x") + pad + M.ORIGIN_SHIFT_M, F.lit(M.ORIGIN_SHIFT_M) - F.col("min_y") + pad
    ranged = boxes.withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom)))).withColumns({
        "_x0": F.greatest(raw(left) - 1, limits[0]), "_x1": F.least(raw(right) + 1, limits[1]),
        "_y0": F.greatest(raw(top) - 1, limits[2]), "_y1": F.least(raw(bottom) + 1, limits[3])}).where("_x1 >= _x0 and _y1 >= _y0")
    few = (F.col("_x1") - F.col("_x0") + 1) * (F.col("_y1") - F.col("_y0") + 1) <= most
    own = ["_x0", "_x1", "_y0", "_y1"]
    spread = ranged.where(few).withColumn("x", F.explode(F.sequence("_x0", "_x1"))).withColumn("y", F.explode(F.sequence("_y0", "_y1"))).drop(*own)
    big = ranged.where(~few).drop(*own)
    if not big.limit(1).count():
        return _met(spread, pad)
    goal = big.withColumnRenamed("z", "_goal")
    # nothing is lost on the way down: a tile's buffered rectangle holds its children's
    now = _met(goal.select("*", F.lit(0).alias("z"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), pad)
    for z in range(max_zoom + 1):
        spread = spread.unionByName(now.where(F.col("_goal") == z).drop("_goal"))
        child = F.explode(F.array(*[F.struct((2 * F.col("x") + dx).alias("x"), (2 * F.col("y") + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)]))
        now = _met(now.where(F.col("_goal") > z).withColumn("_c", child).withColumns({"z": F.col("z") + 1, "x": F.col("_c.x"), "y": F.col("_c.y")}).drop("_c"), pad)
    inside = F.col("x").between(limits[0], limits[1]) & F.col("y").between(limits[2], limits[3])
    return _met(spread.where(inside), pad)


def _met(rows: DataFrame, pad: Column) -> DataFrame:
    x0, y0, x1, y1 = M.tile_bounds_m("z", "x", "y")
    return rows.where((F.col("min_x") <= x1 + pad) & (F.col("max_x") >= x0 - pad) & (F.col("min_y") <= y1 + pad) & (F.col("max_y") >= y0 - pad))


def quantised(point: Column, z, x, y, extent: int = 4096) -> Column:
    """A point in tile coordinates, y down; halves go away from zero."""
    min_x, _, _, max_y = M.tile_bounds_m(z, x, y)
    scale = F.lit(float(extent)) / M.span(z)
    return F.struct(F.round((point.x - min_x) * scale).cast("long").alias("x"), F.round((max_y - point.y) * scale).cast("long").alias("y"))


def without_repeats(points: Column) -> Column:
    """Points that equal the one before go."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def doubled_area(ring: Column) -> Column:
    """Twice the signed area of an open ring; above 0 is clockwise on a y-down screen."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, i: a + F.get(ring, i).x * F.get(ring, (i + 1) % n).y - F.get(ring, (i + 1) % n).x * F.get(ring, i).y)


def wound_ring(ring: Column, exterior: bool) -> Column:
    """An open ring without repeats, exteriors with positive area and holes with negative; null if it has collapsed."""
    first_is_last = lambda c: F.get(c, F.lit(0)) == F.get(c, F.size(c) - 1)
    opened = lambda c: F.when((F.size(c) > 1) & first_is_last(c), F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)
    area = lambda o: F.when(F.size(o) >= 3, doubled_area(o)).otherwise(F.lit(0).cast("long"))
    turned = lambda o, a: F.when(a != 0, F.when(a > 0 if exterior else a < 0, o).otherwise(F.reverse(o)))
    return let(ring, lambda r: let(without_repeats(r), lambda c: let(opened(c), lambda o: let(area(o), lambda a: turned(o, a)))))


def layer_fields(props: DataFrame) -> DataFrame:
    """(layer, key, type): the type of the first value that is not null, over (layer, ord, k, t)."""
    return props.where("t is not null").groupBy("layer", F.col("k").alias("key")).agg(F.min_by("t", "ord").alias("type"))


# Clipping and simplification: topology, in numpy inside Arrow batches.


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, and so on for the others."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())


def clip_lines(xy: np.ndarray, at: np.ndarray, rects: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, where each piece begins and the end, number of its line): the pieces of lines, each within its own closed
    rectangle, in order: each segment's share, put together where they touch. ``at``: where each line begins, and the end."""
    line = np.repeat(np.arange(len(at) - 1), np.diff(at))
    seg = np.flatnonzero(line[1:] == line[:-1])
    a, d, rect = xy[seg], xy[seg + 1] - xy[seg], rects[line[seg]]
    t0, t1 = np.zeros(len(a)), np.ones(len(a))
    for k in (0, 1):
        moves = d[:, k] != 0
        step = np.where(moves, d[:, k], 1.0)
        low, high = (rect[:, k] - a[:, k]) / step, (rect[:, k + 2] - a[:, k]) / step
        t0 = np.where(moves, np.maximum(t0, np.minimum(low, high)), t0)
        t1 = np.where(moves, np.minimum(t1, np.maximum(low, high)), np.where((a[:, k] < rect[:, k]) | (a[:, k] > rect[:, k + 2]), -1.0, t1))
    kept = np.flatnonzero(t0 < t1)
    if not len(kept):
        return np.empty((0, 2)), np.zeros(1, np.int64), np.empty(0, np.int64)
    seg, a, d, t0, t1 = seg[kept], a[kept], d[kept], t0[kept, None], t1[kept, None]
    # a segment goes on with the piece before it if the one before reaches their common point
    new = np.concatenate([[True], ~((np.diff(seg) == 1) & (t0[1:, 0] == 0) & (t1[:-1, 0] == 1)), [True]])
    begins, ends = new[:-1], new[1:]
    place = np.arange(len(seg)) + np.cumsum(ends) - ends
    out = np.empty((len(seg) + ends.sum(), 2))
    out[place] = np.where(t0 != 0, a + d * t0, a)
    out[place[ends] + 1] = np.where(t1 < 1, a + d * t1, xy[seg + 1])[ends]
    return out, np.append(place[begins], len(out)), line[seg[begins]]


def clip_line(p: np.ndarray, rect: tuple[float, float, float, float]) -> list[np.ndarray]:
    """The pieces of one line."""
    xy, at, _ = clip_lines(p, np.array([0, len(p)]), np.array([rect]))
    return [xy[i:j] for i, j in zip(at[:-1], at[1:])]


def clip_half(rings: list[np.ndarray], axis: int, at: float, keep_above: bool) -> list[np.ndarray]:
    """Closed rings cut at a line: the chains on the kept side, closed along the line between neighbouring crossings."""
    sign, whole, chains = (1 if keep_above else -1), [], []
    for ring in rings:
        inside = sign * (ring[:-1, axis] - at) > 0
        if inside.all():
            whole.append(ring)
            continue
        if not inside.any():
            continue
        start = int(np.flatnonzero(~inside & np.roll(inside, -1))[0])
        pts, ins = np.roll(ring[:-1], -start, 0), np.roll(inside, -start)
        n, chain = len(pts), None
        for i in range(n):
            a, b, ia, ib = pts[i], pts[(i + 1) % n], ins[i], ins[(i + 1) % n]
            if ia != ib:
                cross = a + (b - a) * ((at - a[axis]) / (b[axis] - a[axis]))
                cross[axis] = at
                if ib:
                    chain = [cross]
                else:
                    chain.append(cross)
                    chains.append(chain)
            if ib:
                chain.append(b)
    ends = sorted((tuple((c[e][1 - axis], k, e)) for k, c in enumerate(chains) for e in (0, -1)))
    mate = {}
    for (_, k1, e1), (_, k2, e2) in zip(ends[::2], ends[1::2]):  # the region lies between odd and even crossings
        mate[k1, e1], mate[k2, e2] = (k2, e2), (k1, e1)
    left = set(range(len(chains)))
    while left:
        k = first = min(left)
        out: list = []
        end = -1
        while True:
            left.discard(k)
            out += chains[k] if end == -1 else chains[k][::-1]
            k, e = mate[k, end]
            if k == first and e == 0 or k not in left:
                break
            end = -1 if e == 0 else 0
        whole.append(np.array([*out, out[0]]))
    return whole


def clip_polygons(polys: list[list[np.ndarray]], rect: tuple[float, float, float, float]) -> list[list[np.ndarray]]:
    """Polygons within a rectangle; cut rings are told apart into exteriors and holes by how many others hold them."""
    x0, y0, x1, y1 = rect
    out = []
    for poly in polys:
        rings = [r if np.array_equal(r[0], r[-1]) else np.vstack([r, r[:1]]) for r in poly if len(r) >= 3]
        for axis, at, above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
            rings = [r for r in clip_half(rings, axis, at, above) if len(r) >= 4]
        if len(rings) < 2:
            out += [[r] for r in rings]
            continue
        holders = [[j for j, other in enumerate(rings) if j != i and _holds(other, _inner(r))] for i, r in enumerate(rings)]
        for i, h in enumerate(holders):
            if len(h) % 2 == 0:
                out.append([rings[i]] + [rings[j] for j, g in enumerate(holders) if len(g) == len(h) + 1 and i in g])
    return out


def _inner(ring: np.ndarray) -> np.ndarray:
    """A point just within a ring, next to the middle of its longest edge."""
    d = np.diff(ring, axis=0)
    k = int(np.argmax((d**2).sum(1)))
    normal = np.array([-d[k, 1], d[k, 0]]) * 1e-7
    middle = (ring[k] + ring[k + 1]) / 2
    return middle + normal if _holds(ring, middle + normal) else middle - normal


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    over = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[over], b[over]
    return bool(np.count_nonzero(p[0] < a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])) % 2)


def simplify_all(xy: np.ndarray, at: np.ndarray, tolerance: float | np.ndarray, least: int = 2) -> np.ndarray:
    """Which points of lines Douglas-Peucker keeps: those nearer to the chord than the tolerance (one, or one of each line)
    go; shorter results than ``least`` keep the original. The chords of all lines are split together, level by level."""
    keep = np.ones(len(xy), bool)
    tolerance = np.broadcast_to(tolerance, len(at) - 1)
    long = (np.diff(at) > least) & (tolerance > 0)
    if not long.any():
        return keep
    a, b, tolerance = at[:-1][long], at[1:][long] - 1, tolerance[long]
    keep[ranges(a + 1, b - a - 1)] = False
    while len(a):
        wide = b - a > 1
        a, b, tolerance = a[wide], b[wide], tolerance[wide]
        if not len(a):
            break
        n = b - a - 1
        point, chord = ranges(a + 1, n), np.repeat(np.arange(len(a)), n)
        d, v = xy[b] - xy[a], xy[point] - xy[a][chord]
        norm = np.hypot(d[:, 0], d[:, 1])
        norm = np.where(norm > 0, norm * norm, np.inf)[chord]
        t = np.clip((v * d[chord]).sum(1) / norm, 0, 1)[:, None]
        far = np.hypot(*(v - t * d[chord]).T)
        most = np.maximum.reduceat(far, np.cumsum(n) - n)
        hit = np.flatnonzero((far == most[chord]) & (most > tolerance)[chord])
        split, nth = np.unique(chord[hit], return_index=True)
        middle = point[hit[nth]]
        keep[middle] = True
        a, b, tolerance = np.concatenate([a[split], middle]), np.concatenate([middle, b[split]]), np.tile(tolerance[split], 2)
    few = np.diff(np.concatenate([[0], np.cumsum(keep)])[at]) < np.minimum(least, np.diff(at))
    keep[ranges(at[:-1][few], np.diff(at)[few])] = True
    return keep


def simplify(p: np.ndarray, tolerance: float, least: int = 2) -> np.ndarray:
    return p[simplify_all(p, np.array([0, len(p)]), tolerance, least)]


#: Zooms that one pass descends, after a first one to zoom 2: a row makes 4 + 16 + 64 rows at most.
STEP = 3


def clip(kind: str, polys: list[list[np.ndarray]], rect: tuple[float, float, float, float]) -> list[list[np.ndarray]]:
    """The share of a geometry within a rectangle; empty if there is none."""
    if "Polygon" in kind:
        return clip_polygons(polys, rect)
    if "Line" in kind:
        return [[piece] for poly in polys for ring in poly for piece in clip_line(ring, rect)]
    inside = [[r[((r >= rect[:2]) & (r <= rect[2:])).all(1)] for r in poly] for poly in polys]
    return [poly for poly in ([r for r in poly if len(r)] for poly in inside) if poly]


def geometries(parts: pa.ListArray) -> list[list[list[np.ndarray]]]:
    """Polygons of rings of each row, as views on one array of points."""
    polys, rings = parts.values, parts.values.values
    points = rings.values
    xy = np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
    at, poly_at, ring_at = (a.offsets.to_numpy() for a in (parts, polys, rings))
    ring = lambda r: xy[ring_at[r] : ring_at[r + 1]]
    return [[[ring(r) for r in range(poly_at[k], poly_at[k + 1]) if ring_at[r] < ring_at[r + 1]] for k in range(at[i], at[i + 1])] for i in range(len(parts))]


def parts_of(rows: list[list[list[np.ndarray]]], tolerance: list[float]) -> pa.ListArray:
    """The opposite of ``geometries``; rings are simplified by the tolerance of their row."""
    polys = [poly for row in rows for poly in row]
    rings = [r for poly in polys for r in poly]
    xy, at = np.concatenate(rings) if rings else np.empty((0, 2)), np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int64)
    keep = simplify_all(xy, at, np.repeat(tolerance, [sum(len(poly) for poly in row) for row in rows]), 4)
    xy, at = xy[keep], np.concatenate([[0], np.cumsum(keep)])[at]
    out = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    for offsets in (at, *(np.concatenate([[0], np.cumsum([len(x) for x in level])]) for level in (polys, rows))):
        out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), out)
    return out


class Lines(NamedTuple):
    """Lines in tiles of one zoom: the source of each row, its tile, where its lines begin, where lines begin, and the points."""

    source: np.ndarray
    x: np.ndarray
    y: np.ndarray
    line_at: np.ndarray
    at: np.ndarray
    xy: np.ndarray

    def cut(self, row: np.ndarray, x: np.ndarray, y: np.ndarray, rects: np.ndarray) -> Lines:
        """The shares of the numbered rows within rectangles; rows without one go."""
        n = np.diff(self.line_at)[row]
        line, owner = ranges(self.line_at[row], n), np.repeat(np.arange(len(row)), n)
        size = np.diff(self.at)[line]
        xy, at, piece = clip_lines(self.xy[ranges(self.at[line], size)], np.concatenate([[0], np.cumsum(size)]), rects[owner])
        n = np.bincount(owner[piece], minlength=len(row))
        return Lines(self.source[row[n > 0]], x[n > 0], y[n > 0], np.concatenate([[0], np.cumsum(n[n > 0])]), at, xy)

    def children(self, z: int, share: float) -> Lines:
        """The shares of the four tiles of zoom ``z`` below each tile."""
        begin = self.at[self.line_at[:-1]]
        (x0, y0), (x1, y1) = (f.reduceat(self.xy, begin).T[:, :, None] if len(begin) else np.empty((2, 0, 1)) for f in (np.minimum, np.maximum))
        x, y = 2 * self.x[:, None] + [0, 1, 0, 1], 2 * self.y[:, None] + [0, 0, 1, 1]
        rect = buffered_rect(z, x, y, share)
        row, k = np.nonzero((x0 <= rect[2]) & (x1 >= rect[0]) & (y0 <= rect[3]) & (y1 >= rect[1]))
        return self.cut(row, x[row, k], y[row, k], np.column_stack([side[row, k] for side in rect]))

    def simplified(self, tolerance: float) -> Lines:
        keep = simplify_all(self.xy, self.at, tolerance)
        return self._replace(at=np.concatenate([[0], np.cumsum(keep)])[self.at], xy=self.xy[keep])

    def taken(self, rows: np.ndarray) -> Lines:
        n = np.diff(self.line_at)[rows]
        line = ranges(self.line_at[rows], n)
        size = np.diff(self.at)[line]
        return Lines(self.source[rows], self.x[rows], self.y[rows], np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)]), self.xy[ranges(self.at[line], size)])

    def parts(self) -> pa.ListArray:
        out = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(self.xy[:, k])) for k in (0, 1)], ["x", "y"])
        for at in (self.at, np.arange(len(self.at)), self.line_at):
            out = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), out)
        return out


#: Points of lines that are cut together.
POINTS = 50_000


def lines_of(rows: pa.RecordBatch) -> Iterator[Lines]:
    """Rows of lines, about POINTS at a time."""
    parts, polys, rings = rows.column("parts"), rows.column("parts").values, rows.column("parts").values.values
    line_at, at = polys.offsets.to_numpy()[parts.offsets.to_numpy()].astype(np.int64), rings.offsets.to_numpy().astype(np.int64)
    xy = np.column_stack([rings.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
    x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
    whole = Lines(np.arange(len(rows)), x, y, line_at, at, xy)
    share = (at[line_at[1:]] - at[line_at[0]]) // POINTS
    for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(share)) + 1):
        yield whole.taken(own)


def buffered_rect(z: int, x: int, y: int, share: float) -> tuple[float, float, float, float]:
    span = 2 * M.ORIGIN_SHIFT_M / 2.0**z
    pad = span * share
    return x * span - M.ORIGIN_SHIFT_M - pad, M.ORIGIN_SHIFT_M - (y + 1) * span - pad, (x + 1) * span - M.ORIGIN_SHIFT_M + pad, M.ORIGIN_SHIFT_M - y * span + pad


def descend(kind: str, polys: list[list[np.ndarray]], z: int, x: int, y: int, last: int, share: float) -> Iterator[tuple[int, int, int, list]]:
    """(z, x, y, share of the geometry) of a tile's descendants down to zoom ``last``, each cut from its parent's share."""
    if z == last or not polys:
        return
    low = np.min([r.min(0) for poly in polys for r in poly], axis=0)
    high = np.max([r.max(0) for poly in polys for r in poly], axis=0)
    for k in range(4):
        child = z + 1, 2 * x + (k & 1), 2 * y + (k >> 1)
        rect = buffered_rect(*child, share)
        if low[0] > rect[2] or high[0] < rect[0] or low[1] > rect[3] or high[1] < rect[1]:
            continue
        within = low[0] >= rect[0] and high[0] <= rect[2] and low[1] >= rect[1] and high[1] <= rect[3]
        own = polys if within else clip(kind, polys, rect)
        if own:
            yield *child, own
            yield from descend(kind, own, *child, last, share)


def clipped_tiles(features: DataFrame, options: MvtOptions) -> DataFrame:
    """Features with each tile (z, x, y) that they show in, ``parts`` clipped to the buffered tile and simplified.

    Geometry goes down zoom by zoom and a tile is cut from its parent's share, whose buffer is twice
    as wide, so a large geometry is read whole once, not once per tile. A pass descends ``STEP``
    zooms; between passes the shares are dealt out anew by tile, so one feature over many tiles is
    work for many tasks. Tiles are those of the dataset's unbuffered bounds.
    """
    boxes = with_bbox(features)
    b = dataset_bounds(boxes).first()
    # the open flag marks shares that the next pass cuts further
    rows = boxes.select(*features.columns, F.lit(0).alias("z"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(True).alias("open"))
    if b is None or b["min_x"] is None:
        return rows.where("false").drop("open")
    spark, share = features.sparkSession, options.buffer / options.extent
    ranges = M.tile_range(F.col("z"), *(F.lit(b[c]) for c in ("min_x", "min_y", "max_x", "max_y")))
    limits = {r[0]: tuple(r[1:]) for r in spark.range(options.max_zoom + 1).select(F.col("id").cast("int").alias("z")).select("z", *ranges).collect()}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    tolerances = {z: 2 * M.ORIGIN_SHIFT_M / 2.0**z / options.extent * options.simplify for z in limits}
    names, tasks = rows.columns, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def one_pass(first: bool, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                open_ = batch.column("open")
                done = batch.filter(pa.compute.invert(open_))
                if len(done):
                    yield done
                todo = batch.filter(open_)
                is_line = pa.compute.match_substring(todo.column("kind"), "Line")
                lines, todo = todo.filter(is_line), todo.filter(pa.compute.invert(is_line))
                made: list[tuple] = []
                held = 0

                def packed(todo: pa.RecordBatch, source, z, x, y, parts: pa.ListArray, further) -> pa.RecordBatch:
                    new = {"z": pa.array(z, pa.int32()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "parts": parts, "open": pa.array(further, pa.bool_())}
                    taken = todo.select([c for c in names if c not in new]).take(pa.array(source, pa.int64()))
                    columns = [new[c] if c in new else taken.column(c) for c in names]
                    if first:
                        return pa.RecordBatch.from_arrays(columns, names)
                    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, batch.schema)], schema=batch.schema)

                def packed_polys() -> pa.RecordBatch:
                    source, z, x, y, polys, tolerance, further = zip(*made)
                    return packed(todo, source, z, x, y, parts_of(list(polys), list(tolerance)), further)

                def packed_lines(own: Lines, z: int, further: bool) -> pa.RecordBatch:
                    return packed(lines, own.source, np.full(len(own.x), z), own.x, own.y, own.parts(), np.full(len(own.x), further))

                for own in lines_of(lines) if len(lines) else ():
                    top = lines.column("z")[0].as_py()  # open shares are of one zoom
                    if first:
                        own = own.cut(np.arange(len(own.x)), own.x, own.y, np.column_stack(buffered_rect(top, own.x, own.y, share)))
                    for z in range(top if first else top + 1, last + 1):
                        own = own.children(z, share) if z > top else own
                        x0, x1, y0, y1 = limits[z]
                        shown = np.flatnonzero((own.x >= x0) & (own.x <= x1) & (own.y >= y0) & (own.y <= y1) & (z >= options.min_zoom))
                        if len(shown):
                            yield packed_lines(own.taken(shown).simplified(tolerances[z]), z, False)
                    if len(own.x) and last < options.max_zoom:
                        yield packed_lines(own, last, True)
                for i, (kind, polys, *tile) in enumerate(zip(todo.column("kind").to_pylist(), geometries(todo.column("parts")), *(todo.column(c).to_pylist() for c in ("z", "x", "y")))):
                    own = clip(kind, polys, buffered_rect(*tile, share)) if first else polys
                    for z, x, y, got in [(*tile, own)] * first + list(descend(kind, own, *tile, last, share)):
                        x0, x1, y0, y1 = limits[z]
                        if got and z >= options.min_zoom and x0 <= x <= x1 and y0 <= y <= y1:
                            made.append((i, z, x, y, got, 0.0 if "Point" in kind else tolerances[z], False))
                        if got and z == last < options.max_zoom:
                            made.append((i, z, x, y, got, 0.0, True))
                        held += sum(len(r) for poly in got for r in poly) + 20
                    if held > 200_000:
                        if made:
                            yield packed_polys()
                        made, held = [], 0
                if made:
                    yield packed_polys()

        return run

    last, first = min(2, options.max_zoom), True
    while True:
        rows = rows.mapInArrow(one_pass(first, last), schema)
        if last == options.max_zoom:
            return rows.drop("open")
        rows = rows.repartition(tasks, "z", "x", "y", "feature_ord", "layer_ord")
        last, first = min(last + STEP, options.max_zoom), False


def tile_geometry(rows: DataFrame, extent: int = 4096) -> DataFrame:
    """Adds ``geom``, parts in tile coordinates ready to encode; features that collapse in their tile go.

    Points: one part. Lines: parts of two points or more. Polygons: an exterior and its holes, each a
    part; a collapsed exterior takes its holes with it.
    """
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    q = lambda ring: F.transform(ring, lambda p: quantised(p, z, x, y, extent))
    rings = F.flatten(F.col("parts"))
    points = F.filter(F.transform(rings, q), lambda r: F.size(r) > 0)
    lines = F.filter(F.transform(rings, lambda r: let(q(r), without_repeats)), lambda r: F.size(r) >= 2)
    wound = lambda ring, outer: wound_ring(q(ring), outer)
    polygon = lambda poly: F.transform(poly, lambda ring, i: F.when(i == 0, wound(ring, True)).otherwise(wound(ring, False)))
    polygons = F.flatten(F.transform(F.filter(F.transform("parts", polygon), lambda p: F.get(p, F.lit(0)).isNotNull()), lambda p: F.filter(p, lambda r: r.isNotNull())))
    geom = F.when(F.col("kind").contains("Point"), points).when(F.col("kind").contains("Line"), lines).otherwise(polygons)
    return rows.withColumn("geom", geom).where(F.size("geom") > 0)
