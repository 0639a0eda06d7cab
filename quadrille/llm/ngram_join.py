"""N-gram Jaccard join: exact links between documents' sets of word shingles, and their groups.

Two documents link when the Jaccard similarity of their sets of distinct SHINGLE-word shingles is at
least SIMILAR per cent. The join skips work through relations between sets:

1. Equal sets are one set from the start. With shingles in hash order, linked sets share at least
   ``spare`` shingles within their first ``n - ceil(0.75 n) + spare``; only these beginnings are dealt
   out, and a set whose beginning holds too few shared shingles has no link. Most sets end here.
2. Index lists. Of each remaining set the shingles that others hold too are ordered, rarest first, and
   the first ``held - ceil(0.75 n) + 1`` are filed, by shingle and size. Sets that link meet in a list.
3. Each list is compared with one set, its leader, the one whose shingles most sets hold. A group of
   near copies so meets one set in its middle, not each other.
4. Answers are derived from the leader's. For X and Y of leader P with overlaps x and y,
   ``|X & Y| = x + y - |P| + (what their differences from P share)``. So two sets that P does not join
   link only if their differences share a known number of shingles, at least one. Differences that
   share too few with other components end here; lists are made of the others, with this number as
   the overlap that prefix, position and length are judged by. Lists are kept in blocks by position,
   and an entry skips the blocks that are too near their lists' ends for it. What is left is compared.

All links between different sets are thus found or lie within a component already; none is dropped
and no list is capped. Text is read in Arrow batches inside tasks; sets live in Spark tables.

Defined results: null or empty text has no shingles and no links; fewer words than a shingle make
one shingle; repeated rows and ids are separate rows of the result; a null doc_id is a row of its
own, and a component's name is its smallest id that is not null; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_count, bucket_of, joined, pack, runs, squeeze, unpack, unsqueeze
from .common import documents, free_name, materialised, small_or_shuffled
from .components import components
from .kernel import U, mixed, pieces, shingle_sets, utf8, words

SHINGLE = 5
SIMILAR = 75
#: In place of a set's name: several sets of one packed chunk.
SEVERAL = U((1 << 64) - 1)
#: Shingles packed at a time.
CHUNK = 2_000_000
SEED = mixed(np.arange(101, 102, dtype=U))[0]


def must_share(n):
    """The least number of shingles that a set linked with one of n shingles has in common with it."""
    return -(-SIMILAR * n // 100)


#: Of a set's n shingles, 1 + n // SPARE more are dealt out than a prefix filter needs, so that as many must be shared.
SPARE = 16
#: Pairs of ids, or names of wanted sets, that are broadcast at most (24 bytes each); joined by shuffle beyond.
BROADCAST_PAIRS = 200_000
#: Pairs with one set that are compared in one place, on average at most.
TOGETHER = 32
#: Sizes filed together: linked sets are at most one band apart, as bands are a little wider than 100 / SIMILAR.
BAND = 1.01 * 100 / SIMILAR
#: Times that differences which share too little are left out before lists are made of them, and the width of blocks of list positions.
NARROWINGS, BLOCK = 2, 4


def spare(n):
    return 1 + n // SPARE


def beginning(n):
    return np.minimum(n, n - must_share(n) + spare(n))


def least_shared(n):
    """Shared shingles in the beginning that any link brings: a partner may be as small as must_share(n)."""
    return spare(must_share(n))


def set_name(s: np.ndarray) -> bytes:
    return int(mixed(s).sum(dtype=U)).to_bytes(8, "big") + int(mixed(s ^ SEED).sum(dtype=U)).to_bytes(8, "big")


def batch_sets(column: pa.Array) -> list[np.ndarray]:
    raw, at = utf8(column)
    return shingle_sets(words(raw, at, fold=True), SHINGLE)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text_hash, text): row_key finds the row again, also one without a doc_id."""
    text_hash = F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(text_hash, 1) * -1).alias("row_key"), text_hash.alias("text_hash"), F.col("text").cast("binary").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text_hash, n, set_id) of each row."""

    def rows(batches):
        for batch in pieces(batches):
            sets = batch_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row_key", "text_hash")), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s) for s in sets], pa.binary())], ["doc_id", "row_key", "text_hash", "n", "set_id"])

    return keyed(docs).mapInArrow(rows, "doc_id long, row_key long, text_hash long, n long, set_id binary")


def _names(b: bytes) -> np.ndarray:
    return np.frombuffer(b, U)


def packed_beginnings(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, tokens, owners, held, held_n): see ``blocks``. held: shared within the chunk.

    An owner is the first half of a set's name. Sets that have it in common are both wanted if one is; only
    if they also linked with each other alone would that link be missed.
    """
    schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary()), ("held", pa.binary()), ("held_n", pa.binary())])

    def chunk(tokens: list, owners: list):
        t = np.concatenate(tokens)
        o = np.repeat(np.array(owners, U), [len(x) for x in tokens])
        order = np.argsort(t, kind="stable")
        t, o = t[order], o[order]
        at = runs(t)
        several = np.diff(at) > 1
        inside = np.repeat(several, np.diff(at))
        held, held_n = np.unique(o[inside], return_counts=True)
        t, o = t[at[:-1]], np.where(several, SEVERAL, o[at[:-1]])
        cut = np.searchsorted(bucket_of(t << U(16), buckets), np.arange(buckets + 1))
        held_cut = np.searchsorted(bucket_of(held, buckets), np.arange(buckets + 1))
        for b in range(buckets):
            x, y = slice(cut[b], cut[b + 1]), slice(held_cut[b], held_cut[b + 1])
            if x.stop > x.start or y.stop > y.start:
                yield b, pack(t[x]), o[x].tobytes(), held[y].tobytes(), held_n[y].astype(np.uint32).tobytes()

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def rows(batches):
        tokens, owners, seen, held = [], [], set(), 0
        for batch in pieces(batches):
            for s in batch_sets(batch.column("text")):
                if not len(s):
                    continue
                name = set_name(s)
                if name in seen:
                    continue
                seen.add(name)
                first = s[: beginning(len(s))] >> U(16)
                tokens.append(first)
                owners.append(int.from_bytes(name[:8], "big"))
                held += len(first)
            if held >= CHUNK:
                yield batch_of(list(chunk(tokens, owners)))
                tokens, owners, seen, held = [], [], set(), 0
        if tokens:
            yield batch_of(list(chunk(tokens, owners)))

    return keyed(docs).select("text").mapInArrow(rows, "bucket int, tokens binary, owners binary, held binary, held_n binary")


def shared_counts(packed: DataFrame, homes: int) -> DataFrame:
    """(owner, shared): at least as many shared shingles as the set's beginning holds.

    A bucket of shingles sends one packed row of counts to each of ``homes`` buckets of owners.
    """
    schema = pa.schema([("home", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary())])

    def bucket(table: pa.Table) -> pa.Table:
        col = lambda name: [x.as_py() for x in table.column(name)]
        t, o = np.concatenate([unpack(x) for x in col("tokens")]), np.concatenate([_names(x) for x in col("owners")])
        held = np.concatenate([_names(x) for x in col("held")])
        held_n = np.concatenate([np.frombuffer(x, np.uint32) for x in col("held_n")]).astype(np.int64)
        if len(t):
            order = np.argsort(t, kind="stable")
            t, o = t[order], o[order]
            at = runs(t)
            several = np.minimum.reduceat(o, at[:-1]) != np.maximum.reduceat(o, at[:-1])
            more = o[np.repeat(several, np.diff(at)) & (o != SEVERAL)]
            held, held_n = np.concatenate([held, more]), np.concatenate([held_n, np.ones(len(more), np.int64)])
        owner, place = np.unique(held, return_inverse=True)
        shared = np.bincount(place, held_n, len(owner)).astype(np.int64)
        cut = np.searchsorted(bucket_of(owner, homes), np.arange(homes + 1))
        out = [(b, owner[x].tobytes(), squeeze(shared[x])) for b in range(homes) if (x := slice(cut[b], cut[b + 1])).stop > x.start]
        return pa.Table.from_pydict(dict(zip(schema.names, zip(*out))), schema) if out else schema.empty_table()

    def home(table: pa.Table) -> pa.Table:
        owner, place = np.unique(joined(table, "owners", _names), return_inverse=True)
        shared = np.bincount(place, joined(table, "counts", unsqueeze), len(owner))
        return pa.table({"owner": owner.view(np.int64), "shared": shared.astype(np.int64)})

    dealt = packed.groupBy("bucket").applyInArrow(bucket, "home int, owners binary, counts binary")
    return dealt.groupBy("home").applyInArrow(home, "owner long, shared long")


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set_id, n, tokens) of the wanted sets (row_key, set_id), each once; tokens ascending. id is a new number."""
    texts = keyed(docs).select("row_key", "text").join(small_or_shuffled(wanted, BROADCAST_PAIRS), "row_key").select("set_id", "text")
    schema = pa.schema([("set_id", pa.binary()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def rows(batches):
        for batch in pieces(batches):
            out = [(name.as_py(), len(s), s.view(np.int64)) for name, s in zip(batch.column("set_id"), batch_sets(batch.column("text"))) if set_name(s) == name.as_py()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # repeated rows bring their set again; numbers are fixed once they are written
    return materialised(texts.mapInArrow(rows, "set_id binary, n long, tokens array<long>").dropDuplicates(["set_id"]).select(F.monotonically_increasing_id().alias("id"), "*"))


def few(df: DataFrame) -> DataFrame:
    return small_or_shuffled(df, BROADCAST_PAIRS)


def brought_together(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with na, ta, nb and tb, the sizes and shingles of both.

    The pairs of each b are dealt into parts of about TOGETHER, and b's shingles travel once a part.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    pairs = pairs.join(few(parts), "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part"))
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")).join(few(pairs), "a")
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")).join(few(pairs.select("b", "part").distinct()), "b")
    return left.join(right, ["b", "part"]).drop("part")


def short_of(na, nb, both):
    """How far two sets are from a link, in units of 1 / (100 + SIMILAR) shingle: they link if it is not above 0."""
    return SIMILAR * (na + nb) - (100 + SIMILAR) * both


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both) of the pairs; both: how many shingles the two sets share."""
    return brought_together(pairs, sets).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("both"))


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(short_of(F.col("na"), F.col("nb"), F.col("both")) <= 0).select("a", "b")


def index_lists(sets: DataFrame) -> DataFrame:
    """(id, weight, t, band): the entries of the index; weight: how many sets hold a shingle of the set, on average."""
    every = sets.select("id", "n", F.explode("tokens").alias("t"))
    df = every.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    must = F.ceil(SIMILAR * F.col("n") / 100)
    ordered = every.join(df, "t").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"), (F.sum("df") / F.first("n")).alias("weight"))
    band = F.floor(F.ln(F.col("n").cast("double")) / F.lit(math.log(BAND)))
    begun = ordered.where(F.size("o") >= must).select("id", "weight", band.alias("band"), F.explode(F.slice("o", F.lit(1), (F.size("o") - must + 1).cast("int"))).alias("x"))
    return begun.select("id", "weight", F.col("x.t").alias("t"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))


def leader_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each set of a list with the list's leader, b; mostly few for a set, as lists of one group have one leader."""
    leader = lists.groupBy("t", "band").agg(F.max(F.struct("weight", "id")).alias("x"), F.count(F.lit(1)).alias("held")).where("held > 1").select("t", "band", F.col("x.id").alias("b"))
    return lists.join(leader, ["t", "band"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def labelled(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs with comp, the component of a that the links give."""
    comps = few(components(links).withColumnRenamed("id", "a"))
    return pairs.join(comps, "a", "left").withColumn("comp", F.coalesce("comp", "a"))


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, comp, short, cost, more, t) of compared pairs with comp: the shingles that only b has, or (more) only a.

    Two sets of one leader must share (short of one + cost of the other) / (100 + SIMILAR) of these to link.
    Only leaders are looked at that join not all their sets, and whose sets are of several components.
    """
    pairs = pairs.withColumn("short", short_of(F.col("na"), F.col("nb"), F.col("both"))).withColumn("cost", (100 + SIMILAR) * (F.col("nb") - F.col("both")) - SIMILAR * (F.col("nb") - F.col("na")))
    open_leaders = pairs.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("far")).where("lo <> hi and far > 0").select("b")
    pairs = materialised(pairs.join(few(materialised(open_leaders)), "b"))
    apart = brought_together(pairs.select("a", "b"), sets).select("a", "b", F.explode(F.array(F.struct(F.lit(False).alias("more"), F.array_except("tb", "ta").alias("ts")), F.struct(F.lit(True).alias("more"), F.array_except("ta", "tb").alias("ts")))).alias("x"))
    return apart.select("a", "b", "x.more", F.explode("x.ts").alias("t")).join(few(pairs.select("a", "b", F.col("na").alias("n"), "comp", "short", "cost")), ["a", "b"])


def narrowed(apart: DataFrame) -> DataFrame:
    """The differences that another component's share, of sets that hold enough of them for a link; with need and df.

    need: so many of its differences a set must share with another; df: how many sets of the leader have this one.
    """
    least = apart.groupBy("b").agg(F.min("short").alias("least_short"), F.min(F.when(F.col("short") > 0, F.col("short"))).alias("least_open"), F.min("cost").alias("least_cost"))
    # of two sets that link across components, one at least is not joined by the leader
    need = F.when(F.col("short") > 0, F.greatest(F.col("short") + F.col("least_cost"), F.col("cost") + F.col("least_short"))).otherwise(F.col("cost") + F.col("least_open"))
    shared = apart.groupBy("b", "more", "t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("far"), F.count(F.lit(1)).alias("df")).where("lo <> hi and far > 0").select("b", "more", "t", "df")
    held = apart.drop("need", "df").join(shared, ["b", "more", "t"]).join(few(least.where("least_open is not null")), "b")
    held = held.withColumn("need", F.greatest(F.ceil(need / (100 + SIMILAR)), F.lit(1))).drop("least_short", "least_open", "least_cost")
    enough = held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("held"), F.first("need").alias("least")).where("held >= least").select("a", "b")
    return materialised(held.join(few(materialised(enough)), ["a", "b"]))


def derived_pairs(apart: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets in different components whose differences from one leader may share enough."""
    rest = ["a", "n", "comp", "short", "cost", "need", "held", "at"]
    ordered = apart.groupBy("b", "a", "n", "comp", "short", "cost", "need").agg(F.array_sort(F.collect_list(F.struct("df", "more", "t"))).alias("o")).withColumn("held", F.size("o"))
    lists = ordered.select("b", *rest[:-1], F.posexplode(F.slice("o", F.lit(1), (F.col("held") - F.col("need") + 1).cast("int"))).alias("at", "x"))
    lists = materialised(lists.select("b", "x.more", "x.t", *rest, F.floor((F.col("held") - F.col("at")) / BLOCK).alias("block")))
    spot = ["b", "more", "t", "block"]
    blocks = lists.groupBy(*spot).agg(F.max(F.col("held") - F.col("at")).alias("rest"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    probing = lists.where("short > 0").drop("block").join(blocks, spot[:-1]).where((F.col("rest") + F.col("at") >= F.col("need")) & ((F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("comp"))))
    other = lists.withColumnsRenamed({c: f"{c}2" for c in rest})
    once = (F.col("short2") <= 0) | (F.col("a") < F.col("a2"))
    could_share = F.least(F.col("held") - F.col("at"), F.col("held2") - F.col("at2")) + F.least("at", "at2")
    could_link = (F.col("comp") != F.col("comp2")) & once & ((100 + SIMILAR) * could_share >= F.col("short") + F.col("cost2"))
    return probing.select(*spot, *rest).join(other, spot).where(could_link).select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b")).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text_hash, n_shingles, component_id) for each row of documents."""
    spark = docs.sparkSession
    sketch = materialised(sketches(docs))
    distinct = sketch.where("n > 0").groupBy("set_id", "n").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("doc_id"))
    shared = shared_counts(packed_beginnings(docs, bucket_count(spark)), bucket_count(spark, 1))
    owner = F.conv(F.substring(F.hex("set_id"), 1, 16), 16, -10).cast("long")
    must = F.ceil(SIMILAR * F.col("n") / 100)
    wanted = materialised(distinct.join(shared, owner == F.col("owner")).where(F.col("shared") >= 1 + F.floor(must / SPARE)).select("row_key", "set_id"))
    sets = candidate_sets(docs, wanted)
    pairs = materialised(compared(materialised(leader_pairs(materialised(index_lists(sets)))), sets))
    links = materialised(linked(pairs))
    apart = materialised(differences(labelled(pairs, links), sets))
    for _ in range(NARROWINGS):
        apart = narrowed(apart)
    links = materialised(links.union(linked(compared(materialised(derived_pairs(apart)), sets))))
    comps = labelled(sets.select(F.col("id").alias("a"), "set_id"), links).select("set_id", "comp")
    named = distinct.select("set_id", "doc_id").join(comps, "set_id")
    names = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(names, "comp").select("set_id", "component_id")
    own = distinct.select("set_id", F.col("doc_id").alias("first_id"))
    by_set = own.join(by_set, "set_id", "left").select("set_id", F.coalesce("component_id", "first_id").alias("component_id"))
    return sketch.join(by_set, "set_id", "left").select("doc_id", "row_key", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest id (of equal ids that of the smallest text hash), and all without words.

    Rows of one id and text are one document; columns of any name are kept.
    """
    found = materialised(groups(docs).where("n_shingles > 0"))
    first = found.where("doc_id <=> component_id").groupBy(F.col("component_id").alias("comp")).agg(F.min("text_hash").alias("first_hash"))
    judged = found.join(first, F.col("component_id").eqNullSafe(F.col("comp")), "left")
    own = [free_name(docs, c) for c in ("row_key", "row_hash", "held")]
    key = [F.col("row_key").alias(own[0]), F.col("text_hash").alias(own[1])]
    losers = materialised(judged.where("not (doc_id <=> component_id) or text_hash > first_hash").select(*key).distinct())
    same = lambda d: (F.coalesce(d["doc_id"].cast("long"), F.shiftrightunsigned(F.xxhash64(d["text"]), 1) * -1) == F.col(own[0])) & (F.xxhash64(d["text"]) == F.col(own[1]))
    kept = docs.join(small_or_shuffled(losers, BROADCAST_PAIRS), same(docs), "left_anti")
    again = materialised(found.groupBy(*key).agg(F.count(F.lit(1)).alias(own[2])).where(F.col(own[2]) > 1).select(*own[:2]))
    if not again.limit(1).count():
        return kept
    again = small_or_shuffled(again, BROADCAST_PAIRS)
    once = kept.join(again, same(kept), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same(kept), "left_anti").unionByName(once)


def op9(spark, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
