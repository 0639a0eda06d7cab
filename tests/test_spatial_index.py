"""Points in areas against testing every pair."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import catalogue
from quadrille.functions.mercator import ORIGIN_SHIFT_M
from quadrille.operators import spatial_index as S


def points_of(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "id long, x double, y double")


def dense(n, seed=0):
    """A third of all points in one place, a third around another, the rest anywhere."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.full((n // 3, 2), 12345.678), rng.normal(5e6, 2e4, (n // 3, 2)), rng.uniform(-ORIGIN_SHIFT_M, ORIGIN_SHIFT_M, (n - 2 * (n // 3), 2))])


def test_curves_visit_every_cell_once():
    x, y = (v.ravel() for v in np.meshgrid(np.arange(16), np.arange(16)))
    for code in (S.z_code(x, y), S.hilbert(x, y, 4)):
        assert sorted(code.tolist()) == list(range(256))
    order = np.argsort(S.hilbert(x, y, 4))
    assert (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 300, 5000])
def test_packed_tree_finds_what_lies_within(n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 50, (2, n)).astype(float)
    tree = S.PackedTree(x, y)
    for _ in range(30):
        (x0, x1), (y0, y1) = (np.sort(rng.integers(-5, 55, 2)).astype(float) for _ in range(2))
        got = tree.within(x0, y0, x1, y1)
        assert len(got) == len(set(got.tolist())) == int(((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)).sum())


def test_no_leaf_beyond_its_share(spark):
    given = S.located(points_of(spark, dense(3000))).cache()
    tree = S.build(given, parts=20, depth=9)
    assert tree.counts.sum() == 3000 and tree.share == 150 and len(tree.counts) <= 4 * 9 * 20
    hot = tree.counts > tree.share
    assert hot.sum() >= 1 and (tree.levels[hot] == 9).all() and (tree.counts / tree.salts() <= tree.share).all()
    given.unpersist()


@pytest.mark.parametrize("depth", [3, 14])
def test_counts_of_rectangles(spark, depth):
    rng = np.random.default_rng(depth)
    xy = dense(2000, depth)
    corners = np.concatenate([rng.uniform(-2.2e7, 2.2e7, (40, 4)), rng.normal(5e6, 3e4, (40, 4)), [[12345.678, 12345.678, 12345.678, 12345.678], [-ORIGIN_SHIFT_M, -ORIGIN_SHIFT_M, ORIGIN_SHIFT_M, ORIGIN_SHIFT_M], [1, 1, 0, 0]]])
    corners[:-1] = np.concatenate([np.minimum(corners[:-1, :2], corners[:-1, 2:]), np.maximum(corners[:-1, :2], corners[:-1, 2:])], 1)
    boxes = spark.createDataFrame([(f"b{k % 80}", *map(float, c)) for k, c in enumerate(corners)], "k string, min_x double, min_y double, max_x double, max_y double")
    want = {}
    for k, (x0, y0, x1, y1) in enumerate(corners):
        n = int(((xy[:, 0] >= x0) & (xy[:, 0] <= x1) & (xy[:, 1] >= y0) & (xy[:, 1] <= y1)).sum())
        want[f"b{k % 80}"] = want.get(f"b{k % 80}", 0) + n
    got = {r["k"]: r["n"] for r in S.points_within(points_of(spark, xy), boxes, parts=12, depth=depth).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_counts_of_rings(spark):
    xy = dense(900, 4)
    star = [(5e6 + r * np.cos(a), 5e6 + r * np.sin(a)) for a, r in zip(np.linspace(0, 2 * np.pi, 10, endpoint=False), [4e4, 1e4] * 5)]
    hole = [(5e6 - 5e3, 5e6 - 5e3), (5e6 + 5e3, 5e6 - 5e3), (5e6 + 5e3, 5e6 + 5e3), (5e6 - 5e3, 5e6 + 5e3)]
    rings = [np.array(star), np.array(hole)]
    parts = [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]]
    box = [float(v) for v in (*rings[0].min(0), *rings[0].max(0))]
    areas = spark.createDataFrame([(1, *box, parts)], "k long, min_x double, min_y double, max_x double, max_y double, parts array<array<array<struct<x:double,y:double>>>>")
    (r,) = S.points_within(points_of(spark, xy), areas, parts=8).collect()
    assert r["n"] == int(S.in_rings(xy[:, 0], xy[:, 1], rings).sum()) > 20


def test_nothing_to_find(spark):
    some = points_of(spark, [(0, 0)])
    boxes = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0)], "k int, min_x double, min_y double, max_x double, max_y double")
    assert S.points_within(some, boxes).count() == 0 and S.points_within(some.where("id < 0"), boxes).count() == 0
    assert S.points_within(some.withColumn("x", F.lit(None).cast("double")), boxes).count() == 0 and S.points_within(some, boxes.where("k > 1")).count() == 0


def test_points_on_the_edges_of_boxes_count_as_in_sql(spark, tmp_path):
    # a latitude whose tangent and logarithm the JVM rounds otherwise: point 79,538 lies a bit above box 4,088
    rows = [(k,) for k in (79538, 79588, 28538, 48472, 84422)]
    boxes = [(k,) for k in (4088, 2538, 1488, 5472)]
    spark.createDataFrame(rows, "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(boxes, "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    expected = con.execute(catalogue.oracle_sql()["points_in_boxes"]).fetchall()
    assert sorted(map(tuple, catalogue.points_in_boxes(spark, str(tmp_path)).collect())) == sorted(expected)
