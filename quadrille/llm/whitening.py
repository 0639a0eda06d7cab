"""Embedding whitening: covariance by one aggregation of generated SQL, eigenvectors by LAPACK.

Entries become whole numbers, ``floor(scale * c) + offset``. One aggregation counts the vectors and
sums each dimension exactly; a second sums the centred products of the upper triangle of dimension
pairs, one generated expression a pair, so that every task sends one row of sums and no vector
moves. The driver holds a few numbers for each pair of dimensions, however many vectors there are,
decomposes the covariance and sends back a matrix of components, with which tasks project their
vectors in Arrow batches. The whitened vectors are written once, and the same aggregation over them
gives the error against the identity.

Defined results: null vectors and those that hold null, NaN or infinite entries are left out; so are
those of another length than most vectors have (of equally common lengths the longest counts). Null
or repeated ids do not matter. Components are numbered by falling eigenvalue, each turned so that its
largest entry is positive. A component without variance (equal vectors, or fewer vectors than
dimensions) is whitened to 0, so the identity error is then 1. Whole numbers beyond 2 ** 40 are
held there, so that sums stay exact; a deviation beyond a long is null. No vectors give no rows.
Columns of other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Whole numbers are held within this, so that a sum over 8 million vectors is a long in any case.
FARTHEST = 1 << 40
#: An eigenvalue up to this share of the largest one and of the dimensions is rounding.
NOTHING = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    trace: float
    #: A column for each component: eigenvector over the root of its eigenvalue, or zeros.
    matrix: np.ndarray


def whole_numbers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) of the vectors that are whole, and their dimensions."""
    entries = F.col("embedding")
    whole = vectors.select("vec_id", entries.cast("array<double>").alias("embedding")).where(entries.isNotNull() & (F.size(entries) > 0))
    whole = whole.where(~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    top = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = top["d"] if top else 0
    held = lambda c: F.least(F.greatest(F.floor(c * float(scale)), F.lit(-FARTHEST)), F.lit(FARTHEST)) + F.lit(offset)
    return whole.where(F.size("embedding") == dims).select("vec_id", F.transform("embedding", held).alias("x")), dims


def upper_triangle(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of the products of every pair of ``columns``, all in one aggregation; a symmetric matrix."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.selectExpr(*[f"sum({columns[i]} * {columns[j]}) as s{k}" for k, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((d, d))
    for (i, j), s in zip(pairs, sums):
        out[i, j] = out[j, i] = s or 0.0
    return out


def fit(numbers: DataFrame, dims: int) -> Whitening | None:
    """The whitening of all vectors of ``numbers``."""
    if not dims:
        return None
    n, *sums = numbers.selectExpr("count(1) as n", *[f"sum(x[{k}]) as s{k}" for k in range(dims)]).first()
    # the mean's whole part is taken off exactly, then the rest
    centred = numbers.selectExpr(*[f"(x[{k}] - {s // n}L) - {s % n / n!r}D as d{k}" for k, s in enumerate(sums)])
    covariance = upper_triangle(centred, [f"d{k}" for k in range(dims)]) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(dims)])
    roots = np.where(values > NOTHING * dims * values[0], np.sqrt(values), np.inf) if values[0] > 0 else np.full(dims, np.inf)
    return Whitening(n, tuple(sums), values, float(np.trace(covariance)), vectors / roots)


def whitened(numbers: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, w0, w1, ...): the squared length of n * x - S, and the first components."""
    n, sums, most = model.n, np.array(model.sums, object), min(components, len(model.sums))
    whole, rest = (sums // n).astype(np.int64), (sums % n / n).astype(float)
    matrix = np.ascontiguousarray(model.matrix[:, :most])

    def project(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
            apart = (flat - whole) - rest
            if len(flat) and (np.abs(apart).max() * n) ** 2 * len(sums) < 2.0**62:
                squares = ((n * (flat - whole) - (sums % n).astype(np.int64)) ** 2).sum(1).tolist()
            else:
                squares = ((n * flat.astype(object) - sums) ** 2).sum(1).tolist()
            w = apart @ matrix
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([v if v < 2**63 else None for v in squares], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in w.T)],
                ["vec_id", "deviation", *(f"w{k}" for k in range(most))],
            )

    return numbers.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, "vec_id long, deviation long, " + ", ".join(f"w{k} double" for k in range(most)))


def identity_error(white: DataFrame, n: int) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    names = [c for c in white.columns if c.startswith("w")]
    means = white.selectExpr(*[f"sum({c}) / {n}D as {c}" for c in names]).first()
    centred = white.selectExpr(*[f"{c} - {m!r}D as {c}" for c, m in zip(names, means)])
    return float(np.abs(upper_triangle(centred, names) / n - np.eye(len(names))).max())


def op12(spark, sf_dir: str) -> DataFrame:
    numbers, dims = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model = fit(numbers, dims)
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], columns)
    white = materialised(whitened(numbers, model))
    error = identity_error(white, model.n)
    most = min(COMPONENTS, dims)
    shares: Column = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values[:most]])
    each = white.select("vec_id", "deviation", F.posexplode(F.array(*[f"w{k}" for k in range(most)])).alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
