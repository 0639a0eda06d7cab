"""Benchmark decontamination: item-sized windows of documents against benchmark items.

DataFrame functions only. Words are runs of anything but white space, A-Z lower-cased; a shingle is
SHINGLE words (all words of a shorter item). A window is as long as an item, or the whole text if
that is shorter. Every window that could reach the similarity starts at a shingle of an item of its
size, or ends the text, so these are the windows that get a 64-bit SimHash of their shingles:

1. Multi-index Hamming search. The prints of items are filed in ``radius + 1`` blocks of bits; a window
   looks its own blocks up, and whatever differs in at most ``radius`` bits shares one of them at least.
   With radius 7 a block of 8 bits meets one item in 256 by chance.
2. Windows within the radius are verified: the similarity of the two bags of shingles (weighted by how
   often they stand there) is exact.
3. Similarity 0.75 makes 11 of 64 bits differ on average, so windows with edits may lie beyond a radius
   that an index can use. These are not lost: windows also look up the items that hold the shingle they
   start at, and those beyond the radius are verified as well, unless the similarity is out of reach.

All lookups are one join (broadcast if counted to be small), and no text is shuffled.

Defined results: null or empty texts and items match nothing; an item or document without an id
keeps its null; of several windows the most similar one is reported, then the first; repeated rows
of one id and text are reported once; an empty table of either kind gives an empty table; columns of
any name are kept by ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, materialised, small_or_shuffled

SHINGLE = 5
SIMILAR = 0.75
RADIUS = 7
#: Shingles of a text that are looked up from one row.
STEP = 64
FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, *FOLD), " "), "")


def shingle_list(words: str, k: int) -> Column:
    """A hash of each k words of an array column."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Shingles whose votes 16 bits can count.
LANE = 65_535


def simhash(shingles: Column) -> Column:
    """Bit b is set if more of the shingles have it set than not; repeated shingles weigh as often.

    Votes are counted for four bits at a time, in lanes of 16 bits; longer lists are counted in parts.
    """
    zero, lanes = F.lit(0).cast("bigint"), F.lit(0x0001000100010001).cast("bigint")
    right = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    votes = lambda part, j: F.aggregate(part, zero, lambda acc, h: acc + right(h, j).bitwiseAND(lanes))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(shingles) / LANE).cast("int")), lambda p: F.slice(shingles, p * LANE + 1, LANE))
    counted = F.transform(parts, lambda part: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: votes(part, j)))
    held = lambda c, b: F.aggregate(c, zero, lambda acc, v: acc + right(F.get(v, b % 16), 16 * F.floor(b / 16).cast("int")).bitwiseAND(F.lit(LANE).cast("bigint")))
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
    return let(counted, lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda acc, b: F.when(2 * held(c, b) > F.size(shingles), acc.bitwiseOR(bit(b))).otherwise(acc)))


def block_values(print_: Column, radius: int) -> list[Column]:
    """The bits of each of radius + 1 blocks."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [print_.bitwiseAND(F.lit(((1 << hi) - (1 << lo)) - (1 << 64 if hi == 64 else 0)).cast("bigint")) for lo, hi in zip(edges[:-1], edges[1:])]


def bag_overlap(a: Column, b: Column) -> Column:
    """The size of the intersection of two bags."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, similarity) of documents that hold an item."""
    items = benchmark.select("item_id", word_list(F.col("text")).alias("w")).where("size(w) > 0").withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    found = None
    for k in sorted(r["k"] for r in items.select("k").distinct().collect()):  # at most SHINGLE values
        own = items.where(F.col("k") == k).withColumn("item", shingle_list("w", k)).withColumn("m", F.size("item")).withColumn("item_print", simhash(F.col("item"))).select("item_id", "item", "m", "item_print")
        # items are filed under their blocks, and under their shingles
        filed = [F.struct(F.lit(i).alias("kind"), v.alias("value")) for i, v in enumerate(block_values(F.col("item_print"), radius))]
        shingles = F.transform(F.array_distinct("item"), lambda x: F.struct(F.lit(radius + 1).alias("kind"), x.alias("value")))
        index = own.select("item_id", "item", "m", "item_print", F.explode(F.concat(F.array(*filed), shingles)).alias("x")).select("item_id", "item", "m", "item_print", "x.kind", "x.value")
        sizes = index.where(F.col("kind") == radius + 1).groupBy(F.col("value").alias("shingle")).agg(F.collect_set("m").alias("sizes"))
        text = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), word_list(F.col("text")).alias("w")).withColumn("s", shingle_list("w", k)).select("doc_id", "text_hash", "s", F.size("s").alias("n"))
        # a row of the explosion carries the part of the list that its windows lie in, not the list
        longest = own.agg(F.max("m")).first()[0]
        step = max(STEP, longest)
        base = lambda b: b * step
        first = lambda b: F.greatest(base(b) - longest, F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), F.expr(f"(n - 1) div {step}").cast("int")), lambda b: F.struct(base(b).alias("base"), first(b).alias("first"), F.slice("s", first(b) + 1, F.lit(step + 2 * longest)).alias("s")))
        # outer, as Spark would else test the list's size below, and compute the words for each element there
        part_rows = text.select("doc_id", "text_hash", "n", F.explode_outer(F.when(F.col("n") > 0, parts)).alias("x")).select("doc_id", "text_hash", "n", "x.base", "x.first", "x.s")
        every = part_rows.select("*", F.posexplode_outer(F.slice("s", F.col("base") - F.col("first") + 1, step)).alias("pos", "shingle"))
        hits = every.join(small_or_shuffled(sizes), "shingle").select("*", F.explode("sizes").alias("m"))
        start = F.least(F.col("base") + F.col("pos"), F.greatest(F.col("n") - F.col("m"), F.lit(0)))
        windows = hits.select("doc_id", "text_hash", "shingle", "m", start.alias("start"), F.slice("s", start - F.col("first") + 1, F.col("m")).alias("window"))
        # outer, so that the print is computed once and not for each block
        probe = lambda d: F.array(*[F.struct(F.lit(i).alias("kind"), v.alias("value"), d.alias("print")) for i, v in enumerate(block_values(d, radius))], F.struct(F.lit(radius + 1).alias("kind"), F.col("shingle").alias("value"), d.alias("print")))
        probes = windows.select("doc_id", "text_hash", "m", "start", "window", F.explode_outer(let(simhash(F.col("window")), probe)).alias("x")).select("doc_id", "text_hash", "m", "start", "window", "x.kind", "x.value", "x.print")
        met = probes.join(small_or_shuffled(index), ["kind", "m", "value"])
        differ = F.col("print").bitwiseXOR(F.col("item_print"))
        within = F.bit_count(differ) <= radius
        # a pair that several blocks meet is taken at the first of them
        equal = F.coalesce(*[F.when(v == 0, F.lit(i)) for i, v in enumerate(block_values(differ, radius))], F.lit(-1))
        reach = lambda w: let(F.size(F.filter(w, lambda x: F.array_contains("item", x))), lambda o: o >= similar * (F.size(w) + F.size("item") - o))
        near = met.where(F.when(F.col("kind") <= radius, within & (equal == F.col("kind"))).otherwise(~within & reach(F.col("window"))))
        share = let(F.col("window"), lambda w: let(bag_overlap(w, F.col("item")), lambda o: o / (F.size(w) + F.size("item") - o)))
        alike = near.withColumn("similarity", share).where(F.col("similarity") >= similar)
        part = alike.select("doc_id", "text_hash", "item_id", "start", "similarity")
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, similarity double")
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("b.back")).cast("long").alias("start_word"), F.col("b.similarity").alias("similarity"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    own = [free_name(docs, c) for c in ("bad_id", "bad_hash")]
    bad = materialised(contaminated(docs, benchmark).select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1])).distinct())
    return docs.join(small_or_shuffled(bad), F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.xxhash64("text") == F.col(own[1])), "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start_word", "similarity")


_words = r"list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '')"
#: Brute force over shingles: all windows that start at a shared shingle or end the text.
SQL = f"""
with i0 as (select item_id, {_words} w from benchmark),
i1 as (select item_id, w, least(len(w), {SHINGLE}) k from i0 where len(w) > 0),
item as (select item_id, k, len(w) - k + 1 m, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) s from i1),
bag as (select item_id, k, m, s, count(*) c from item group by all),
d0 as (select distinct doc_id, text, {_words} w from documents),
ks as (select distinct k from bag),
d1 as (select doc_id, text, k, w, len(w) - k + 1 n from d0, ks where len(w) >= k),
sh as (select doc_id, text, k, n, unnest(generate_series(0, n - 1)) p, unnest(list_transform(generate_series(1, n), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) s from d1),
hit as (select sh.doc_id, sh.text, sh.k, sh.n, sh.p, sh.s, b.item_id, b.m, b.c from sh join bag b on b.s = sh.s and b.k = sh.k),
win as (select distinct doc_id, text, n, item_id, m, least(p, greatest(n - m, 0)) start from hit),
part as (select w.doc_id, w.text, w.item_id, w.start, w.n, w.m, h.s, least(count(*), any_value(h.c)) o from win w join hit h
  on h.doc_id is not distinct from w.doc_id and h.text = w.text and h.item_id is not distinct from w.item_id and h.p between w.start and w.start + w.m - 1 group by all),
sim as (select doc_id, text, item_id, start, sum(o)::double / (least(m, n) + m - sum(o)) v from part group by doc_id, text, item_id, start, m, n)
select doc_id, item_id, max_by(start, (v, -start))::bigint start_word, max(v) similarity from sim where v >= {SIMILAR} group by doc_id, text, item_id
"""
