"""Suffix-array dedup: bytes covered by a LENGTH-byte string that starts in an earlier document too.

The index is a family of suffix arrays of geometric sizes. It is dealt out over Spark's partitions
by content, so no part of it grows with the corpus faster than the number of partitions:

1. Anchors. Every LENGTH-byte string holds a minimizer, its first GRAM-byte string of smallest
   hash; equal strings hold it at the same place. Anchors of two different documents are found by
   dealing out packed hashes. A string whose anchor stands in one document alone starts in no other.
2. Segments. Around each shared anchor, the run of LENGTH-byte strings that belong to it is cut
   out. Segments meet by anchor.
3. Levels. In each part, the segments' suffixes come in batches by doc_id. A batch gets a suffix
   array (suffixes are told apart by their first LENGTH bytes, so it is ordered by a hash of them),
   which is merge-scanned against the existing levels for matches with smaller doc_ids; then it
   becomes a level, and levels of equal size merge.
4. The covered ranges go back to the documents, and the rest of each text is kept.

Whole texts are indexed; whatever repeats within a task is settled there, so a passage that stands
in very many documents sends one segment per packed chunk.

Defined results: null text is empty; a null doc_id is larger than any other; rows of one doc_id are
no smaller than each other; strings are judged on the input; texts shorter than LENGTH bytes stay;
matches never cross documents; an empty table gives an empty table.

Ranges go back to documents by doc_id and, where several rows have one doc_id or none, by a salt
made of the text (0 for all others).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_count, bucket_of, joined, pack, runs, squeeze, unpack, unsqueeze
from .common import documents, materialised
from .kernel import U, mixed, pieces, powers, prefix_sums, utf8

LENGTH = 50
GRAM = 20
#: Anchors, bytes of text, and bytes of segments packed at a time.
CHUNK_ANCHORS, CHUNK_TEXT, CHUNK_SEGMENTS = 1_000_000, 8 << 20, 8 << 20
#: Suffixes in the first level, and parts of the index for each shuffle partition.
BATCH, PARTS = 1 << 18, 4
#: Families of levels of each part, by anchor; one is in memory at a time.
FAMILIES = 8
NO_ID = np.iinfo(np.int64).max


def grams(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` bytes."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = prefix_sums(raw)
    return mixed((sums[length:] - sums[:n]) * powers(len(raw) + 1)[1][:n])


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, first, last): each anchor, and the first and last start of a run of strings that belong to it.
    A string's key is the smallest hash alone; where its minimizer stands in it does not matter."""
    span = LENGTH - GRAM + 1
    if len(raw) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, U, np.int64, np.int64))
    best, width = grams(raw, GRAM), 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    new = np.ones(len(best), bool)
    np.not_equal(best[1:], best[:-1], out=new[1:])
    # runs begin anew with a row, and behind its last string, where strings would cross into the next row
    count = np.maximum(np.diff(at) - LENGTH + 1, 0)
    begin, count = at[:-1][count > 0], count[count > 0]
    borders = np.concatenate([begin, begin + count])
    new[borders[borders < len(best)]] = True
    cut = np.flatnonzero(new)
    last = np.append(cut[1:] - 1, len(best) - 1)
    row = np.searchsorted(at, cut, "right") - 1
    ok = cut + LENGTH <= at[row + 1]
    cut, last, row = cut[ok], last[ok], row[ok]
    return row, best[cut] >> U(16), cut, last


def _ids(batch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _cuts(buckets_of: np.ndarray, buckets: int):
    """(bucket, slice) of each bucket that has rows, in an ascending array of buckets."""
    cut = np.searchsorted(buckets_of, np.arange(buckets + 1))
    return [(b, slice(cut[b], cut[b + 1])) for b in range(buckets) if cut[b + 1] > cut[b]]


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mixed(ids.view(U)), buckets).astype(np.int64)


BINARY = pa.binary()
ANCHORS = pa.schema([("bucket", pa.int32()), ("keys", BINARY), ("docs", BINARY), ("many", BINARY), ("held_keys", BINARY), ("held_docs", BINARY)])
SHARED = pa.schema([("bucket", pa.int32()), ("keys", BINARY), ("docs", BINARY)])
TEXTS = pa.schema([("bucket", pa.int32()), ("texts", BINARY), ("sizes", BINARY), ("docs", BINARY)])
SEGMENTS = pa.schema([("bucket", pa.int32()), ("texts", BINARY), ("sizes", BINARY), ("docs", BINARY), ("starts", BINARY), ("families", BINARY), ("held_docs", BINARY), ("held_starts", BINARY), ("held_ends", BINARY), ("salts", BINARY), ("held_salts", BINARY)])
RANGES = pa.schema([("bucket", pa.int32()), ("docs", BINARY), ("starts", BINARY), ("ends", BINARY), ("salts", BINARY)])


def packed_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors by key. Those of several documents of a chunk are held, and travel once among many."""

    def chunk(keys, ids):
        k, d = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(k)
        k, d = k[order], d[order]
        at = runs(k)
        least = np.minimum.reduceat(d, at[:-1])
        several = least != np.maximum.reduceat(d, at[:-1])
        inside = np.repeat(several, np.diff(at))
        hk, hd = k[inside], d[inside]
        order = np.lexsort((hd, hk))
        hk, hd = hk[order], hd[order]
        new = np.ones(len(hk), bool)
        new[1:] = (hk[1:] != hk[:-1]) | (hd[1:] != hd[:-1])
        hk, hd = hk[new], hd[new]
        many, k, d = k[at[:-1]][several], k[at[:-1]][~several], least[~several]
        held = dict(_cuts(bucket_of(hk << U(16), buckets), buckets))
        more = dict(_cuts(bucket_of(many << U(16), buckets), buckets))
        alone = dict(_cuts(bucket_of(k << U(16), buckets), buckets))
        for b in sorted(alone.keys() | more.keys()):
            s, m, h = (x.get(b, slice(0, 0)) for x in (alone, more, held))
            yield b, pack(k[s]), squeeze(d[s]), pack(many[m]), pack(hk[h]), squeeze(hd[h])

    def rows(batches):
        keys, ids, n = [], [], 0
        for batch in pieces(batches):
            raw, at = utf8(batch.column("text"))
            row, key, _, _ = anchors(raw, at)
            keys.append(key)
            ids.append(_ids(batch)[row])
            n += len(key)
            if n >= CHUNK_ANCHORS:
                yield _batch(list(chunk(keys, ids)), ANCHORS)
                keys, ids, n = [], [], 0
        if n:
            yield _batch(list(chunk(keys, ids)), ANCHORS)

    return docs.mapInArrow(rows, _rows(ANCHORS))


def shared_anchors(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket of doc, keys, docs): the anchors of each document that other documents hold too."""

    def bucket(table: pa.Table) -> pa.Table:
        k, d = joined(table, "keys", unpack), joined(table, "docs", unsqueeze)
        hk, hd = joined(table, "held_keys", unpack), joined(table, "held_docs", unsqueeze)
        many = joined(table, "many", unpack)
        single = np.repeat([True, False], [len(k), len(many)])
        k, d = np.concatenate([k, many]), np.concatenate([d, np.zeros(len(many), np.int64)])
        order = np.argsort(k, kind="stable")
        k, d, single = k[order], d[order], single[order]
        at = runs(k)
        several = (np.minimum.reduceat(d, at[:-1]) != np.maximum.reduceat(d, at[:-1])) | ~np.logical_and.reduceat(single, at[:-1])
        go = np.repeat(several, np.diff(at)) & single
        k, d = np.concatenate([hk, k[go]]), np.concatenate([hd, d[go]])
        home = doc_bucket(d, buckets)
        order = np.lexsort((k, d, home))
        k, d, home = k[order], d[order], home[order]
        out = [(b, squeeze(k[s].view(np.int64)), squeeze(d[s])) for b, s in _cuts(home, buckets)]
        return pa.Table.from_batches([_batch(out, SHARED)] if out else [], SHARED)

    return packed.groupBy("bucket").applyInArrow(bucket, _rows(SHARED))


def packed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Whole texts by a hash of doc_id, compressed together."""

    def chunk(texts, ids):
        home = doc_bucket(ids, buckets)
        order = np.argsort(home, kind="stable")
        for b, s in _cuts(home[order], buckets):
            own = [texts[i] for i in order[s]]
            yield b, zstandard.compress(b"".join(own), 3), squeeze(np.array([len(x) for x in own])), squeeze(ids[order[s]])

    def rows(batches):
        texts, ids, n = [], [], 0
        for batch in pieces(batches):
            own = [x.as_py() or b"" for x in batch.column("text")]
            texts += own
            ids.append(_ids(batch))
            n += sum(map(len, own))
            if n >= CHUNK_TEXT:
                yield _batch(list(chunk(texts, np.concatenate(ids))), TEXTS)
                texts, ids, n = [], [], 0
        if texts:
            yield _batch(list(chunk(texts, np.concatenate(ids))), TEXTS)

    return docs.mapInArrow(rows, _rows(TEXTS))


def unpacked(table: pa.Table):
    """(bytes, starts and end, doc of each) of each packed row of texts."""
    for texts, sizes, docs in zip(table.column("texts"), table.column("sizes"), table.column("docs")):
        size = unsqueeze(sizes.as_py())
        raw = zstandard.decompress(texts.as_py(), max_output_size=max(1, int(size.sum())))
        yield np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(size)]), unsqueeze(docs.as_py())


def gathered(table: pa.Table, most: int = 1 << 20):
    """The same, of several packed rows at a time, until they hold ``most`` bytes."""
    held, n = [], 0

    def together():
        sizes = np.concatenate([np.diff(at) for _, at, _ in held])
        return np.concatenate([raw for raw, _, _ in held]), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([docs for _, _, docs in held])

    for row in unpacked(table):
        held.append(row)
        n += len(row[0])
        if n >= most:
            yield together()
            held, n = [], 0
    if held:
        yield together()


def pair(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One hash of a doc and an anchor; a chance equality makes a segment that meets no other."""
    return mixed(mixed(docs.view(U)) + keys)


def by_doc(docs: np.ndarray, *others: np.ndarray) -> dict[int, tuple]:
    order = np.argsort(docs, kind="stable")
    docs, others = docs[order], [x[order] for x in others]
    at = runs(docs)
    return {int(docs[a]): tuple(x[a:b] for x in others) for a, b in zip(at[:-1], at[1:])}


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges put together where they overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > far[:-1]])
    return starts[new], far[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(far) - 1]])]


def ranges_of(docs: np.ndarray, salts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same, for the ranges of many documents at once."""
    if not len(docs):
        return docs, salts, starts, ends
    order = np.lexsort((starts, salts, docs))
    docs, salts, starts, ends = docs[order], salts[order], starts[order], ends[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (salts[1:] != salts[:-1])])
    number = np.cumsum(new) - 1
    wide = int(ends.max()) + 2
    lo, hi = union(starts + number * wide, ends + number * wide)
    at = lo // wide
    return docs[new][at], salts[new][at], lo % wide, hi - at * wide


def repeated(table: pa.Table) -> set[int]:
    """The docs that several rows of a bucket of texts have; all rows of a doc are in one bucket."""
    docs, n = np.unique(joined(table, "docs", unsqueeze), return_counts=True)
    return set(docs[n > 1].tolist())


def salt_of(text: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha256(text.tobytes()).digest()[:7], "big") + 1


def segments(texts: DataFrame, shared: DataFrame, buckets: int, parts_of_index: int) -> DataFrame:
    """Segments around shared anchors, by anchor. Equal ones of a chunk travel with their smallest doc only."""

    def chunk(parts):
        key, doc, start, content, size, salt = (np.concatenate(x) for x in list(zip(*parts))[:6])
        whole = np.concatenate([p[6] for p in parts])
        at = np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((doc, content, key))
        same = runs_of_two(key[order], content[order])
        least = np.repeat(doc[order][same[:-1]], np.diff(same))
        later = doc[order] > least
        hd, hsalt, hs, he = ranges_of(doc[order][later], salt[order][later], start[order][later], (start + size)[order][later])
        go = order[~later]
        home = bucket_of(key[go] << U(16), parts_of_index).astype(np.int64)
        held_home = doc_bucket(hd, parts_of_index)
        ho = np.argsort(held_home, kind="stable")
        held = dict(_cuts(held_home[ho], parts_of_index))
        open_ = dict(_cuts(home, parts_of_index))
        for b in sorted(held.keys() | open_.keys()):
            s, h = go[open_.get(b, slice(0, 0))], ho[held.get(b, slice(0, 0))]
            family = (key[s] % U(FAMILIES)).astype(np.int64)
            s = s[np.argsort(family, kind="stable")]
            raw = b"".join(whole[at[i] : at[i + 1]].tobytes() for i in s)
            yield b, zstandard.compress(raw, 3), squeeze(size[s]), squeeze(doc[s]), squeeze(start[s]), squeeze(np.bincount(family, minlength=FAMILIES)), squeeze(hd[h]), squeeze(hs[h]), squeeze(he[h]), squeeze(salt[s]), squeeze(hsalt[h])

    def runs_of_two(a, b):
        return np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]])

    def cut(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        held = np.sort(pair(joined(right, "docs", unsqueeze), joined(right, "keys", unsqueeze).view(U)))
        out, parts, n, several = [], [], 0, np.array(sorted(repeated(left)), np.int64)
        for raw, at, docs in gathered(left) if len(held) else ():
            row, key, first, last = anchors(raw, at)
            own = pair(docs[row], key)
            mine = held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own
            row, key, first, last = row[mine], key[mine], first[mine], last[mine]
            if not len(key):
                continue
            size = last + LENGTH - first
            sums = prefix_sums(raw)
            content = mixed((sums[last + LENGTH] - sums[first]) * powers(len(raw) + 1)[1][first] + size.astype(U))
            put = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            salts = np.zeros(len(docs), np.int64)
            for i in np.flatnonzero(np.isin(docs, several)):
                salts[i] = salt_of(raw[at[i] : at[i + 1]])
            parts.append((key, docs[row], first - at[row], content, size, salts[row], raw[put]))
            n += int(size.sum())
            if n >= CHUNK_SEGMENTS:
                out.append(_batch(list(chunk(parts)), SEGMENTS))
                parts, n = [], 0
        if parts:
            out.append(_batch(list(chunk(parts)), SEGMENTS))
        return pa.Table.from_batches(out, SEGMENTS)

    return texts.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(cut, _rows(SEGMENTS))


class Levels:
    """A family of suffix arrays of geometric sizes; each entry is a suffix and the smallest doc that holds it."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # (size class, suffixes, docs), large to small

    def add(self, suffix: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Adds a batch; whether each of its suffixes starts in a smaller doc of the batch or of any level."""
        order = np.argsort(suffix)
        s, d = suffix[order], doc[order]
        at = runs(s)
        s1, d1 = s[at[:-1]], np.minimum.reduceat(d, at[:-1])
        earlier = d1.copy()
        for _, ls, ld in self.levels:
            place = np.minimum(np.searchsorted(ls, s1), len(ls) - 1)
            earlier = np.where(ls[place] == s1, np.minimum(earlier, ld[place]), earlier)
        found = np.zeros(len(suffix), bool)
        found[order] = d > np.repeat(earlier, np.diff(at))
        self.levels.append((0, s1, d1))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            rank, s2, d2 = self.levels.pop()
            _, s3, d3 = self.levels.pop()
            s, d = np.concatenate([s3, s2]), np.concatenate([d3, d2])
            order = np.argsort(s, kind="stable")  # merges two sorted runs
            s, d = s[order], d[order]
            at = runs(s)
            self.levels.append((rank + 1, s[at[:-1]], np.minimum.reduceat(d, at[:-1])))
        return found


def contents(whole: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each segment, a batch of them at a time."""
    out, done = np.zeros(len(at) - 1, U), 0
    while done < len(out):
        upto = max(done + 1, int(np.searchsorted(at, at[done] + 4 * BATCH, "right")) - 1)
        sums, place = prefix_sums(whole[at[done] : at[upto]]), at[done : upto + 1] - at[done]
        out[done:upto] = mixed((sums[place[1:]] - sums[place[:-1]]) * powers(len(sums))[1][place[:-1]] + np.diff(place).astype(U))
        done = upto
    return out


def scanned(whole: np.ndarray, size: np.ndarray, doc: np.ndarray, begin: np.ndarray, salt: np.ndarray) -> list[tuple]:
    """(docs, salts, starts, ends) of the matches with smaller docs among segments, a batch of them at a time, so that only the levels grow.
    Of equal segments those of the smallest doc go into the levels; the others are matches as wholes."""
    at = np.concatenate([[0], np.cumsum(size)])
    content = contents(whole, at)
    order = np.argsort(content)
    same = runs(content[order])
    least = np.empty(len(doc), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], same[:-1]), np.diff(same))
    later = doc > least
    found = [(doc[later], salt[later], begin[later], (begin + size)[later])]
    order = np.flatnonzero(~later)
    order = order[np.argsort(doc[order], kind="stable")]
    far = np.cumsum(size[order] - LENGTH + 1)
    index, done = Levels(), 0
    while done < len(order):
        upto = max(done + 1, int(np.searchsorted(far, (far[done - 1] if done else 0) + BATCH, "right")))
        own = order[done:upto]
        done = upto
        raw = np.concatenate([whole[at[i] : at[i + 1]] for i in own])
        count = size[own] - LENGTH + 1
        first = np.cumsum(count) - count
        h = grams(raw, LENGTH)[np.repeat(np.cumsum(size[own]) - size[own] - first, count) + np.arange(int(count.sum()))]
        hit = index.add(h, np.repeat(doc[own], count))
        # matches side by side in a segment are one range
        begins, ends = hit.copy(), hit.copy()
        begins[1:] &= ~hit[:-1]
        begins[first] = hit[first]
        ends[:-1] &= ~hit[1:]
        ends[first + count - 1] = hit[first + count - 1]
        low, high = np.flatnonzero(begins), np.flatnonzero(ends)
        of = np.searchsorted(first, low, "right") - 1
        start = begin[own[of]] - first[of]
        found.append((doc[own[of]], salt[own[of]], start + low, start + high + LENGTH))
    return [ranges_of(*(np.concatenate(x) for x in zip(*found)))]


def covered(parts: DataFrame, buckets: int) -> DataFrame:
    """(bucket of doc, docs, starts, ends): the ranges that earlier documents hold."""

    def bucket(table: pa.Table) -> pa.Table:
        found = [(joined(table, "held_docs", unsqueeze), joined(table, "held_salts", unsqueeze), joined(table, "held_starts", unsqueeze), joined(table, "held_ends", unsqueeze))]
        for family in range(FAMILIES):
            own = []
            begins, families, salts = iter(table.column("starts")), iter(table.column("families")), iter(table.column("salts"))
            for raw, at, docs in unpacked(table):
                begin, salt, cut = unsqueeze(next(begins).as_py()), unsqueeze(next(salts).as_py()), np.concatenate([[0], np.cumsum(unsqueeze(next(families).as_py()))])
                if len(docs) and cut[family + 1] > cut[family]:
                    x, y = cut[family], cut[family + 1]
                    own.append((raw[at[x] : at[y]], np.diff(at[x : y + 1]), docs[x:y], begin[x:y], salt[x:y]))
            if own:
                found += scanned(*(np.concatenate(x) for x in zip(*own)))
        docs, salts, lo, hi = ranges_of(*(np.concatenate(x) for x in zip(*found)))
        home = doc_bucket(docs, buckets)
        order = np.argsort(home, kind="stable")
        out = [(b, squeeze(docs[order[s]]), squeeze(lo[order[s]]), squeeze(hi[order[s]]), squeeze(salts[order[s]])) for b, s in _cuts(home[order], buckets)]
        return pa.Table.from_batches([_batch(out, RANGES)] if out else [], RANGES)

    return parts.groupBy("bucket").applyInArrow(bucket, _rows(RANGES))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", BINARY), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))])


def dedup(docs: DataFrame, kept_bytes: bool = True) -> DataFrame:
    """Per document (doc_id, text): the columns of RESULT; ``kept`` is null unless asked for."""
    buckets = bucket_count(docs.sparkSession)
    parts = bucket_count(docs.sparkSession, PARTS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = packed_texts(docs, buckets)
    shared = shared_anchors(packed_anchors(docs, buckets), buckets)
    # ranges go home to one bucket a partition: parts of the index times buckets bounds their rows
    homes = bucket_count(docs.sparkSession, 1)
    ranges = materialised(covered(segments(texts, shared, buckets, parts), homes))

    def rest(key, left: pa.Table, right: pa.Table) -> pa.Table:
        removed = by_doc(joined(right, "docs", unsqueeze), joined(right, "salts", unsqueeze), joined(right, "starts", unsqueeze), joined(right, "ends", unsqueeze))
        none, several = (np.zeros(0, np.int64),) * 3, repeated(left)
        out = []
        for raw, at, ids in unpacked(left):
            for i, d in enumerate(ids):
                own = raw[at[i] : at[i + 1]]
                salt, lo, hi = removed.get(int(d), none)
                mine = salt == (salt_of(own) if int(d) in several else 0)
                lo, hi = union(lo[mine], hi[mine])
                kept = b"".join(own[a:b].tobytes() for a, b in zip(np.concatenate([[0], hi]), np.concatenate([lo, [len(own)]])))
                out.append((None if d == NO_ID else int(d), len(own), len(own) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept if kept_bytes else None, lo, hi))
        return pa.Table.from_batches([_batch(out, RESULT)] if out else [], RESULT)

    return packed_texts(docs, homes).groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, span_starts array<long>, span_ends array<long>")


def op3(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), kept_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
