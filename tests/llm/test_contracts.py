"""Each query over tables of hard cases, against SQL or brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from quadrille.llm import entry

from .conftest import DOCS

QUERIES = entry.queries()
SMALL = "/root/testdata/sf0.001"
TYPE = {"op1": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}, "op2": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}, "op3": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}, "op6": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}, "op7": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}, "op8": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}, "op9": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}, "op10": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}, "op11": {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint", "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"}, "op12": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}, "op13": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}}


def rows(df, names=None):
    names = sorted(names or df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_and_types(spark, folders, name):
    df = QUERIES[name](spark, folders["empty"])
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in TYPE.get(name.split("_")[0], {})} == TYPE.get(name.split("_")[0], {})
    assert df.count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns_change_nothing(spark, folders, name):
    expected = QUERIES[name](spark, folders["hard"])
    # mixing keeps extra columns, but for those that it sets
    assert rows(expected) == rows(QUERIES[name](spark, folders["extra"]), expected.columns)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, folders, sql, name):
    df = QUERIES[name](spark, folders["hard"])
    names, expected = sql(folders["hard"], entry.oracle_sql()[name])
    assert names == sorted(df.columns)
    assert rows(df) == expected


def texts(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def luhn(d):
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


KINDS = ("email", "ip", "card", "phone")


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@pytest.mark.parametrize("which", ["hard", SMALL])
def test_pii_base(spark, folders, which):
    folder = folders.get(which, which)
    got = QUERIES["op1_pii"](spark, folder)
    expected = []
    for d, t in texts(spark, folder):
        s = base_spans(t)
        n = Counter(k for _, k, _ in s)
        expected.append((d, n[0], n[1], n[2], n[3], hashlib.sha256(listed(s).encode()).hexdigest()))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:6]) for r in got.collect())
    base = defaultdict(set)
    for d, t in texts(spark, folder):
        base[d].update(listed(base_spans(t)).split(","))
    once = {d for d, n in Counter(d for d, _ in texts(spark, folder)).items() if n == 1}
    assert all(base[r["doc_id"]] <= set(r["spans"].split(",")) for r in got.collect() if r["doc_id"] in once)


@pytest.mark.parametrize("which", ["hard", SMALL])
def test_suffix_dedup(spark, folders, which):
    folder = folders.get(which, which)
    docs = [(d, t.encode()) for d, t in texts(spark, folder)]
    first = {}
    for d, raw in docs:
        key = float("inf") if d is None else d
        for i in range(len(raw) - 49):
            g = raw[i : i + 50]
            first[g] = min(first.get(g, key), key)
    expected = []
    for d, raw in docs:
        key, hit = float("inf") if d is None else d, bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < key:
                hit[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        expected.append((d, len(raw), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    got = QUERIES["op3_suffix_dedup"](spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in got)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("which", ["hard", SMALL])
def test_ngram_join(spark, folders, which):
    folder = folders.get(which, which)
    docs = [(d, shingles(t)) for d, t in texts(spark, folder)]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = defaultdict(list)
    for i, (d, s) in enumerate(docs):
        if d is not None:
            ids[d].append(i)
        for j in range(i):
            both = len(s & docs[j][1])
            if both and 100 * both >= 75 * len(s | docs[j][1]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            smallest[root(i)] = min(smallest.get(root(i), d), d)
    expected = [(d, len(s), smallest.get(root(i)) if s else d) for i, (d, s) in enumerate(docs)]
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in QUERIES["op9_ngram_join"](spark, folder).collect())


@pytest.mark.parametrize("which", ["hard", SMALL])
def test_quality_base(spark, folders, which):
    folder = folders.get(which, which)
    expected = []
    for d, t in texts(spark, folder):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = Counter(windows)
        repeated = {i + j for i, x in enumerate(windows) if again[x] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        expected.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w)))
    got = QUERIES["op8_quality_rules"](spark, folder).collect()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:7]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)


@pytest.mark.parametrize("which", ["hard", SMALL])
def test_license_base(spark, folders, which):
    folder = folders.get(which, which)
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    expected = []
    for d, t in texts(spark, folder):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        expected.append((d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = QUERIES["op10_license_scan"](spark, folder).collect()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:6]) for r in got)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_fixture_is_read_whole(spark, folders):
    for name in ("op1_pii", "op3_suffix_dedup", "op8_quality_rules", "op9_ngram_join", "op10_license_scan"):
        assert QUERIES[name](spark, folders["hard"]).count() == len(DOCS)
