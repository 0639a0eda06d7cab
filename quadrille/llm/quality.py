"""Quality rules: gradient-boosted trees over document statistics.

Statistics are computed over whole texts inside Spark tasks. The trees are grown on a bounded
sample of labelled documents (SAMPLE rows, those of smallest hash of doc_id; it is the only
sample), with histograms, Newton steps and monotonic constraints, and flattened into numpy node
arrays; every document is then scored, level by level, without a loop over rows.

A document is kept if the base rules pass and the score is at least KEEP_AT. Defined results: null
or empty text has no words and fails; a document without a label is only scored; labels that
contradict each other for one doc_id are both rows of the sample; without any labels of both kinds
the base rules alone decide; a null doc_id is scored; repeated rows score alike; an empty table
gives an empty table; documents' other columns are kept by ``keep`` and dropped by ``statistics``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .kernel import SPACE, U, pieces, utf8, windows, words

#: Labelled rows that the trees are grown on, at most.
SAMPLE = 8_000
KEEP_AT = 0.5
TREES, DEPTH, RATE, BINS, LEAST, L2 = 40, 3, 0.2, 32, 12, 1.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features, and the direction in which the score may move as they grow (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "punct_share": -1,
    "distinct_share": 0,
    "top_word_share": -1,
    "words_a_line": 0,
    "short_line_share": -1,
}


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each text: columns as in COUNTS and FEATURES."""
    raw, at = utf8(column)
    n = len(column)
    w = words(raw, at)
    every = windows(w.hash, 5)
    length = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    starts = (raw & 0xC0) != 0x80  # one byte of each code point
    n_words = np.diff(w.first)
    word_chars = length(starts & ~SPACE[raw])
    n_symbols, n_upper, n_digits = length(SYMBOLS[raw]), length(UPPER[raw]), length(DIGITS[raw])
    n_punct = length((raw > 32) & (raw < 127) & ~UPPER[raw] & ~DIGITS[raw] & ~((raw >= 97) & (raw <= 122)))
    n_dup, n_repeat, n_distinct, top, n_lines, n_short = (np.zeros(n, np.int64) for _ in range(6))
    whole = raw.tobytes()
    for i in range(n):
        a, b = w.first[i], w.first[i + 1]
        if a == b:
            continue
        seen: set[bytes] = set()
        for line in whole[at[i] : at[i + 1]].split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                n_lines[i] += 1
                n_short[i] += line.count(b" ") < 2
                if line in seen:
                    n_dup[i] += 1
                else:
                    seen.add(line)
        ordered = np.sort(w.hash[a:b])
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        n_distinct[i], top[i] = len(edges) - 1, np.diff(edges).max()
        if b - a > 5:
            own = every[a : b - 4]
            ordered = np.sort(own)
            again = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(again):
                place = np.minimum(np.searchsorted(again, own), len(again) - 1)
                hit = np.flatnonzero(again[place] == own)
                step = np.zeros(b - a + 1, np.int64)
                np.add.at(step, hit, 1)
                np.add.at(step, hit + 5, -1)
                n_repeat[i] = np.count_nonzero(np.cumsum(step)[:-1])
    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    w1, c1, l1 = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    features = np.stack(
        [np.log1p(n_words), word_chars / w1, n_symbols / c1, n_dup / l1, n_repeat / w1, n_upper / c1, n_digits / c1, n_punct / c1, n_distinct / w1, top / w1, n_words / l1, n_short / l1], 1
    )
    return counts, features


@dataclass
class Trees:
    """All trees as flat arrays: node i sends x[feature] <= cut to left, else to right; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = tuple(FEATURES.values())) -> Trees | None:
    """Boosted trees for labels y; None if there is only one kind of label.

    A split on a constrained feature must have child values in the constraint's order, and the
    values below it stay on their side of the middle of the two.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    raw = np.full(len(y), bias)
    nodes: list[list[float]] = []
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, depth: int) -> int:
        value = lambda a, b: float(np.clip(-a / (b + L2), low, high))
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        if depth and len(rows) >= 2 * LEAST:
            for j, sign in enumerate(signs):
                k = len(cuts[j])
                if not k:
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, v, k + 1))[:-1] for v in (g[rows], h[rows], None))
                gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + L2), low, high), np.clip(-gr / (hr + L2), low, high)
                gain = -(gl * vl + 0.5 * (hl + L2) * vl**2) - (gr * vr + 0.5 * (hr + L2) * vr**2)
                gain[(nl < LEAST) | (nr < LEAST) | (sign * (vr - vl) < 0)] = -np.inf
                i = int(np.argmax(gain))
                if np.isfinite(gain[i]) and (best is None or gain[i] > best[0]):
                    best = (gain[i], j, i, vl[i], vr[i])
            own = value(gs, hs)
            if best and best[0] <= -(gs * own + 0.5 * (hs + L2) * own**2) + 1e-6:
                best = None
        if best is None:
            return leaf(RATE * value(gs, hs))
        _, j, i, vl, vr = best
        middle = (vl + vr) / 2
        below, above = ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle)) if signs[j] < 0 else ((low, high), (low, high))
        at = leaf(0.0)
        go = binned[rows, j] <= i
        children = build(rows[go], g, h, *below, depth - 1), build(rows[~go], g, h, *above, depth - 1)
        nodes[at] = [j, cuts[j][i], *children, 0.0]
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        first = len(nodes)
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p), -4.0, 4.0, DEPTH))
        flat = np.array(nodes[first:])
        node = np.zeros(len(y), np.int64)
        for _ in range(DEPTH):
            f = flat[node, 0].astype(np.int64)
            node = np.where(x[np.arange(len(y)), f] <= flat[node, 1], flat[node, 2], flat[node, 3]).astype(np.int64) - first
        raw += flat[node, 4]
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees for the label ``quality`` from the ``sample`` labelled documents of smallest hash."""
    chosen = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label_quality")).where("label_quality is not null and label_id is not null")
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "label_quality").limit(sample)
    # sample bounds the labels, so that they may be broadcast
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", F.col("label_quality").cast("int").alias("label_quality"), "text")

    def features(batches):
        for batch in pieces(batches):
            x = measure(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([batch.column("label_id").cast(pa.int64()), batch.column("label_quality"), pa.array(list(x), pa.list_(pa.float64()))], ["label_id", "quality", "x"])

    # ids that many rows have bring more rows than there are labels: of these, sample too
    measured = rows.mapInArrow(features, "label_id long, quality int, x array<double>")
    got = measured.orderBy(F.xxhash64("label_id"), "label_id", "quality", "x").limit(sample).select("quality", "x").toPandas()
    if not len(got):
        return None
    x, y = np.stack(got["x"]), got["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order of rows
    return grow(x[order], y[order])


def statistics(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, the counts, base_failed, score, kept) for every document."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"

    def rows(batches):
        for batch in pieces(batches):
            counts, x = measure(batch.column("text"))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            score = trees.score(x) if trees else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_AT))], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, schema)


def keep(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The documents that pass, with all their columns."""

    def rows(batches):
        for batch in pieces(batches):
            counts, x = measure(batch.column("text"))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            yield batch.filter(pa.array(~failed & ((trees.score(x) if trees else np.ones(len(x))) >= KEEP_AT)))

    return docs.mapInArrow(rows, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return statistics(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
