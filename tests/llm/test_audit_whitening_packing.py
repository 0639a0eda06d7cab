"""The filter audit, embedding whitening and packing against brute force."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadrille.llm import bin_plan, filter_audit, packing, whitening

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", range(6))
def test_plain_changes_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for i in filter_audit.plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_walk_agrees_with_filtering_one_after_another():
    rng = random.Random(5)
    names = list("PQRS")
    docs = [(rng.randrange(16), rng.random() < 0.4, rng.random() < 0.2) for _ in range(300)]
    cells = defaultdict(lambda: [0, 0, 0])
    for m, good, toxic in docs:
        cells[m] = [a + b for a, b in zip(cells[m], (1, good, toxic))]
    got = filter_audit.walk(names, np.array(list(cells)), *np.array(list(cells.values())).T)
    assert len(got) == 24 * 4
    rows, shapley = {}, defaultdict(int)
    for order in itertools.permutations(range(4)):
        left = docs
        for k, f in enumerate(order):
            out = [d for d in left if d[0] >> f & 1]
            left = [d for d in left if not d[0] >> f & 1]
            shapley[f] += len(out)
            fails = sum(m >> f & 1 for m, _, _ in docs)
            rows["".join(names[f] for f in order), k + 1] = (len(left), len(out), fails - len(out), sum(m == 1 << f for m, _, _ in docs), sum(d[1] for d in out), sum(d[2] for d in out), f)
    for r in got.itertuples():
        *want, f = rows[r.filter_order, r.step]
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == tuple(want) and r.shapley == shapley[f]


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "x"), (2, "a b c", "y"), (3, "a", None), (None, "a", "x"), (None, None, "x"), (7, "", "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    filters = {"short": F.size("words") < 2, "copy": filter_audit.COPY}
    cells = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in filter_audit.mask_cells(docs, labels, filters, "source").collect()}
    assert cells == {("x", 0): (1, 0, 0), ("x", 2): (1, 1, 1), ("y", 2): (1, 1, 1), ("", 1): (1, 0, 0), ("x", 1): (3, 0, 0)}
    with pytest.raises(ValueError):
        filter_audit.mask_cells(docs, labels, {str(k): filter_audit.COPY for k in range(9)})


def whitened_by_numpy(rows, dims):
    """Vectors and what the contract says of them, in one piece."""
    kept = [(i, e) for i, e in rows if e and len(e) == dims and all(c is not None and np.isfinite(c) for c in e)]
    x = np.floor(64 * np.array([e for _, e in kept], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    apart = n * x - s
    values, vectors = np.linalg.eigh((apart / n).T @ (apart / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(dims)])
    most = min(32, dims)
    return sorted((str(i), k + 1, n, int((a * a).sum()), float(w[k]), values[k] / values.sum()) for (i, _), a, w in zip(kept, apart, (apart / n) @ vectors[:, :most] / np.sqrt(values[:most])) for k in range(most))


@pytest.mark.parametrize("which", ["hard", SMALL])
def test_whitening(spark, folders, which):
    folder = folders.get(which, which)
    table = pq.read_table(f"{folder}/embeddings.parquet").to_pydict()
    want = whitened_by_numpy(list(zip(table["vec_id"], table["embedding"])), 4 if which == "hard" else 64)
    found = whitening.op12(spark, folder).collect()
    got = sorted((str(r["vec_id"]), r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in found)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-7, atol=1e-7)
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and max(errors) < 1e-6


def test_whitening_without_variance_and_of_far_entries(spark):
    schema = "vec_id long, embedding array<double>"
    numbers, dims = whitening.whole_numbers(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))
    model = whitening.fit(numbers, dims)
    white = whitening.whitened(numbers, model)
    assert [tuple(r) for r in white.collect()] == [(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)] and whitening.identity_error(white, model.n) == 1.0
    numbers, dims = whitening.whole_numbers(spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 2.5]), (3, [0.0, 1.0])], schema))
    far = whitening.whitened(numbers, whitening.fit(numbers, dims)).collect()
    assert [r["deviation"] is None for r in far] == [True, True, False]


def check_plan(kinds, counts):
    capacity, held = len(counts) - 1, np.zeros(len(counts), int)
    for kind in kinds:
        assert kind.bins > 0 and kind.room == capacity - sum(n * e for n, e in kind.holds) >= 0
        for length, each in kind.holds:
            held[length] += each * kind.bins
    assert (held == counts).all()
    return sum(k.bins for k in kinds)


@pytest.mark.parametrize("capacity, items", [(10, 1), (10, 60), (100, 400), (2048, 5000), (7, 0)])
def test_plans_hold_all_and_need_few_bins(capacity, items):
    rng = np.random.default_rng(capacity + items)
    for low, high in ((1, capacity), (capacity // 3 + 1, capacity), (max(1, capacity // 8), max(1, capacity // 2))):
        counts = np.bincount(rng.integers(low, high + 1, items), minlength=capacity + 1)
        bound = -(-int(counts @ np.arange(capacity + 1)) // capacity)
        bound = max(bound, int(counts[capacity // 2 + 1 :].sum()))
        bins = check_plan(bin_plan.plan(counts), counts)
        assert bound <= bins <= bound * 1.03 + 1 or bins <= check_plan(bin_plan.best_fit([], counts, capacity), counts)


def test_configurations_reach_the_optimum_of_a_known_case():
    # sizes 6, 3 and 2 of a bin of 12, each filling bins by itself or mixed: no room is left
    found = bin_plan.configurations(np.array([6, 3, 2]), np.array([40, 40, 60]), 12)
    assert sum(n for _, n in found) >= 38 and all((held * [6, 3, 2]).sum() <= 12 for held, _ in found)


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def by_tokenizers(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


HARD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \n b", "x   y", "x \u00a0\u3000 y <|endoftext|>  z", "<|endoftext|>", "a<|endoftext|> b", "don't  'S 's we'll", "\u00e9t\u00e9 \u2603 \U0001f600 " * 3, "\r\n x\r\n\r\n  y", "\x1c x \x1c\x1cy", "x" * 5000, " " * 5000]


def test_ids_are_those_of_tokenizers(encoder):
    assert encoder.fast
    texts = HARD + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()
    assert all(encoder.ids(t).tolist() == by_tokenizers(encoder, t) for t in texts)
    assert encoder.ids(" " * 400_000).tolist() == by_tokenizers(encoder, " " * 400_000)


def test_other_tokenizers_are_left_to_tokenizers():
    import public_tokenizers

    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and other.ids("Hello  World").tolist() == by_tokenizers(other, "Hello  World")


@pytest.mark.parametrize("which", ["hard", SMALL])
def test_packing(spark, folders, encoder, which):
    folder = folders.get(which, which)
    table = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    ids = [np.array([*by_tokenizers(encoder, t), 0], "<u4") for t in table["text"]]
    want = []
    for doc, x in zip(table["doc_id"], ids):
        head = len(x) % 2048 or 2048
        cuts = [0, *range(head, len(x) + 1, 2048)]
        want += [(str(doc), k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.op13(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(map(len, ids)) // 2048) + 1


def test_ranks_of_a_hot_length_are_dense(spark):
    pieces = spark.range(5000).select(F.col("id").alias("row_no"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11 + 1).cast("long").alias("length"))
    counts = np.zeros(21, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    found = defaultdict(list)
    for r in packing.ranked(pieces, counts).collect():
        found[r["length"]].append(r["rank"])
    assert all(sorted(v) == list(range(counts[k])) for k, v in found.items())
