"""PII by bootstrapped contextual extraction. DataFrame functions only.

Seeds are what fixed patterns find: emails, IPv4 addresses, card numbers that pass Luhn and phone
numbers (the base), and secrets (long hexadecimal runs; the method's own kind). The word before and
the word after each seed are lexical patterns of its kind. Candidates are other runs of letters,
digits and ``@._%+-`` that have the shape of a kind but fail its pattern. Spark scores the graph of
patterns and instances round by round: a pattern's confidence is the sum of its instances' scores
over all places in the corpus where its word stands; an instance's score is the chance that at least
one of its patterns is right; seeds score 1. Scores only rise, so the rounds end when none rises by
more than SETTLED. Candidates that end at ACCEPT or more are added as spans of their kind. Seeds'
spans always stay.

Statistics cover the whole corpus. Patterns with fewer than SUPPORT distinct seeds are not used.
Offsets are in code points. A neighbouring word is what stands between white space (or the match of
the same pattern before it) and the match, however long. The fixed patterns are written with possessive
repeats and ``\\G`` so that very long runs cost linear time; they find the same leftmost matches. Lists
of matches are walked in blocks of BLOCK, so that a text with very many of them ends.

Defined results: null text is empty; a null doc_id is kept; repeated rows have equal spans; a run
that both a seed and a candidate cover stays the seed's; an empty table gives an empty table; columns
of any name besides doc_id and text are kept by ``mask`` and left out by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, materialised, small_or_shuffled

#: The kinds of the contract in order, and their patterns; then the method's own kind.
BASE = 4
KINDS = ("email", "ip", "card", "phone", "secret")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?:(?<![0-9A-Za-z])|\G)[0-9a-f]{32,}+(?![0-9A-Za-z])",
)
#: A text without a match of these has no seed of the kind.
NEEDS = ("@", "[.][0-9]", "[0-9][ -]?[0-9]", "[+][0-9]", "[0-9a-f]{32}")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CANDIDATE = r"(?:(?<![A-Za-z0-9@._%+-])|\G)[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
SUPPORT, SETTLED, ACCEPT = 3, 0.001, 0.5
#: Matches, and code points of a text, that are walked at a time.
BLOCK, PIECE = 256, 4096
#: Longer words are told apart by their hash.
LONG_WORD = 64
WHITE = "\t\n\x0b\x0c\r"
SPAN = "array<struct<start:int,kind:int,end:int>>"
MATCH = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(n: Column, size: int = BLOCK) -> Column:
    """The first places of the blocks that n places make."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: i * size)).otherwise(F.array().cast("array<int>"))


def running(lengths: Column) -> Column:
    """Sums of all lengths before each place: within blocks, and of blocks."""
    sums = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a.at + x).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")))
    inner = F.transform(blocks(F.size(lengths)), lambda b: sums(F.slice(lengths, b + 1, BLOCK)))
    return let(inner, lambda w: let(sums(F.transform(w, lambda x: x.at)).out, lambda base: F.flatten(F.transform(w, lambda x, i: F.transform(x.out, lambda y: y + F.get(base, i))))))


def folded(word: Column) -> Column:
    """A word as patterns know it."""
    return let(F.regexp_replace(F.lower(word), "[0-9]", "9"), lambda w: F.when(F.length(w) <= LONG_WORD, w).otherwise(F.concat(F.lit("#"), F.xxhash64(w).cast("string"))))


def white(s: Column) -> Column:
    return F.translate(s, WHITE, " " * len(WHITE))


def places(text: Column, pattern: str) -> Column:
    """MATCH of all matches: their lengths and those of the texts between them add up, and these hold the neighbouring words."""

    def found(hits: Column, gaps: Column) -> Column:
        lengths = F.transform(F.sequence(F.lit(0), 2 * F.size(hits) - 1), lambda i: F.length(F.when(i % 2 == 0, F.get(gaps, F.floor(i / 2).cast("int"))).otherwise(F.get(hits, F.floor(i / 2).cast("int")))))
        before = lambda i: folded(F.substring_index(F.rtrim(white(F.get(gaps, i))), " ", -1))
        after = lambda i: folded(F.substring_index(F.ltrim(white(F.get(gaps, i + 1))), " ", 1))
        return let(running(lengths), lambda at: F.transform(hits, lambda s, i: F.struct(F.get(at, 2 * i + 1).alias("start"), (F.get(at, 2 * i + 1) + F.length(s)).alias("end"), s.alias("s"), before(i).alias("before"), after(i).alias("after"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda hits: F.when(F.size(hits) == 0, F.array().cast(MATCH)).otherwise(let(F.split(text, pattern, -1), lambda gaps: found(hits, gaps))))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i))) % 10 == 0


def passes(kind: int, s: Column) -> Column:
    if kind == 1:
        return F.rlike(s, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == 2:
        return let(F.regexp_replace(s, "[ -]", ""), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == 3:
        return F.length(F.regexp_replace(s, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


INSTANCE = "array<struct<start:int,kind:int,end:int,name:string,before:string,after:string>>"


def seed_instances(text: Column) -> Column:
    """INSTANCE of the fixed patterns, by start and then kind."""
    found = []
    for kind, (pattern, need) in enumerate(zip(PATTERNS, NEEDS)):

        def spans(kind=kind, pattern=pattern):
            named = lambda m: F.struct(m.start.alias("start"), F.lit(kind).alias("kind"), m.end.alias("end"), F.lower(m.s).alias("name"), m.before.alias("before"), m.after.alias("after"))
            return F.transform(F.filter(places(text, pattern), lambda m: passes(kind, m.s)), named)

        found.append(F.when(F.rlike(text, F.lit(need)), spans()).otherwise(F.array().cast(INSTANCE)))
    return F.array_sort(F.concat(*found))


def base_spans(text: Column) -> Column:
    """SPAN of the base kinds, by start and then kind."""
    return spans_of(F.filter(seed_instances(text), lambda s: s.kind < BASE))


def spans_of(instances: Column) -> Column:
    return F.transform(instances, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))


def free_of(candidates: Column, spans: Column) -> Column:
    """The candidates that no span meets; each block of them looks at the spans near it alone."""
    meets = lambda s, start, end: (s.start < end) & (start < s.end)

    def block(b: Column) -> Column:
        own = F.slice(candidates, b + 1, BLOCK)
        near = lambda cs: F.filter(spans, lambda s: meets(s, F.get(cs, F.lit(0)).start, F.get(cs, F.size(cs) - 1).end))
        return let(own, lambda cs: let(near(cs), lambda few: F.filter(cs, lambda c: ~F.exists(few, lambda s: meets(s, c.start, c.end)))))

    return F.flatten(F.transform(blocks(F.size(candidates)), block))


def shape(s: Column) -> Column:
    """The kind that a run looks like, or null."""
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return (
        F.when(F.rlike(s, F.lit("^[^@]+@[^@]+$")), 0)
        .when(F.rlike(s, F.lit(r"^[0-9]+(?:\.[0-9]+){3,}$")), 1)
        .when(F.rlike(s, F.lit("^[0-9-]+$")) & digits.between(13, 19), 2)
        .when(F.rlike(s, F.lit(r"^[0-9.+-]+$")) & digits.between(7, 15), 3)
        .when((F.length(s) >= 16) & F.rlike(s, F.lit("[0-9].*[0-9]")) & F.rlike(s, F.lit("^[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*$")), 4)
    )


def extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, seeds, others): the instances with their neighbours."""
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).withColumn("seeds", seed_instances(F.col("text")))
    core = F.transform(places(F.col("text"), CANDIDATE), lambda m: let(F.regexp_replace(m.s, "[._%+-]+$", ""), lambda c: F.struct(m.start.alias("start"), shape(c).alias("kind"), (m.start + F.length(c)).alias("end"), F.lower(c).alias("name"), m.before.alias("before"), m.after.alias("after"))))
    others = let(F.filter(core, lambda c: c.kind.isNotNull()), lambda cs: F.when(F.size(cs) > 0, free_of(cs, F.col("seeds"))).otherwise(F.array().cast(INSTANCE)))
    return text.select("doc_id", "text_hash", "seeds", F.when(F.rlike("text", F.lit("[0-9@]")), others).otherwise(F.array().cast(INSTANCE)).alias("others"))


def accepted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, name, score) of the candidates that the patterns' scores accept."""
    kinds = [("seeds", True), ("others", False)]
    every = None
    for column, seed in kinds:
        part = found.select(F.explode(column).alias("i")).select("i.kind", "i.name", F.lit(seed).alias("seed"), F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("i.before").alias("word")), F.struct(F.lit("after").alias("side"), F.col("i.after").alias("word")))).alias("p")).select("kind", "name", "seed", "p.side", "p.word")
        every = part if every is None else every.union(part)
    edges = materialised(every.where("word <> ''").groupBy("kind", "side", "word", "name", "seed").agg(F.count(F.lit(1)).alias("n")))
    key = ["kind", "side", "word"]
    supported = edges.groupBy(*key).agg(F.count(F.when(F.col("seed"), 1)).alias("seeds"), F.count(F.when(~F.col("seed"), 1)).alias("others"), F.sum("n").alias("seen"))
    # patterns that no candidate shares decide nothing
    used = materialised(supported.where((F.col("seeds") >= SUPPORT) & (F.col("others") > 0)))
    words = docs.select(F.explode(F.split(white(F.regexp_replace(F.lower("text"), "[0-9]", "9")), " ")).alias("word"))
    words = words.select(F.when(F.length("word") <= LONG_WORD, F.col("word")).otherwise(F.concat(F.lit("#"), F.xxhash64("word").cast("string"))).alias("word"))
    # counted in each task before they meet the patterns, so a common word is a row a task there
    totals = words.groupBy("word").agg(F.count(F.lit(1)).alias("total")).join(small_or_shuffled(used.select("word").distinct()), "word")
    patterns = materialised(used.join(totals, "word", "left").select(*key, F.greatest("seen", F.coalesce("total", F.lit(0))).cast("double").alias("total")))
    graph = materialised(edges.join(patterns, key))
    scores = materialised(graph.where("not seed").select("kind", "name").distinct().withColumn("score", F.lit(0.0)))
    rise = 1.0
    while rise > SETTLED:
        held = graph.join(scores, ["kind", "name"], "left").withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        trust = held.groupBy(*key).agg(F.least(F.lit(0.999999), F.sum(F.col("n") * F.col("s")) / F.first("total")).alias("c"))
        risen = materialised(graph.where("not seed").join(trust, key).groupBy("kind", "name").agg((1 - F.exp(F.sum(F.ln(1 - F.col("c"))))).alias("score")))
        rise = risen.join(scores.withColumnRenamed("score", "old"), ["kind", "name"]).agg(F.max(F.col("score") - F.col("old"))).first()[0] or 0.0
        scores = risen
    return scores.where(F.col("score") >= ACCEPT)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, spans): SPAN of the base kinds and of all, for each row."""
    found = materialised(extracted(docs))
    more = found.select("doc_id", "text_hash", F.explode("others").alias("i")).select("doc_id", "text_hash", "i.kind", "i.name", F.struct("i.start", "i.kind", "i.end").alias("span"))
    added = more.join(accepted(docs, found), ["kind", "name"]).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set("span").alias("added"))
    all_ = found.join(added, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    base = spans_of(F.filter("seeds", lambda s: s.kind < BASE))
    return all_.select("doc_id", "text_hash", base.alias("base"), F.array_sort(F.concat(spans_of(F.col("seeds")), F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))


def listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def between(text: Column, start: Column, end: Column) -> Column:
    """Code points of a text given as PIECE-long pieces."""
    first = F.floor(start / PIECE).cast("int")
    return F.when(end > start, F.substr(F.array_join(F.slice(text, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), ""), start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def covered(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins inside the one before it only makes that one longer."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    whole = "array<struct<start:int,kind:int,end:int>>"
    put = lambda m, start, kind, end: F.concat(m, F.array(F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"))))

    def join(merged: Column, s: Column) -> Column:
        last = F.get(merged, F.size(merged) - 1)
        inside = (F.size(merged) > 0) & (s.start < last.end)
        return F.when(inside, put(F.slice(merged, F.lit(1), F.size(merged) - 1), last.start, last.kind, F.greatest(last.end, s.end))).otherwise(put(merged, s.start, s.kind, s.end))

    # spans of a block are put together, then the last one of each block with those of the next
    merged = F.transform(blocks(F.size(spans)), lambda b: F.aggregate(F.slice(spans, b + 1, BLOCK), F.array().cast(whole), join))
    reach = lambda bs: F.transform(bs, lambda x: F.get(x, F.size(x) - 1).end)
    ends = lambda bs: F.aggregate(reach(bs), F.array(F.lit(0)), lambda a, e: F.concat(a, F.array(F.greatest(e, F.get(a, F.size(a) - 1)))))
    # a span that the blocks before it reach into begins at their end, and has no kind
    begun = lambda bs, far: F.flatten(F.transform(bs, lambda x, i: F.transform(x, lambda s: F.struct(F.greatest(s.start, F.get(far, i)).alias("start"), F.when(s.start >= F.get(far, i), s.kind).alias("kind"), F.greatest(s.end, F.get(far, i)).alias("end")))))
    pieces = F.transform(blocks(F.greatest(F.length(text), F.lit(1)), PIECE), lambda b: F.substr(text, b + 1, F.lit(PIECE)))

    def out(cut: Column, ps: Column) -> Column:
        part = lambda s, i: F.concat(between(ps, F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1).end), s.start), F.coalesce(F.get(kinds, s.kind), F.lit("")))
        return F.concat(F.array_join(F.transform(cut, part), ""), between(ps, F.get(cut, F.size(cut) - 1).end, F.length(text)))

    return let(merged, lambda bs: let(ends(bs), lambda far: let(begun(bs, far), lambda cut: let(pieces, lambda ps: out(cut, ps)))))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars follows if there is one."""
    own = [free_name(docs, c) for c in ("id", "hash", "spans")]
    hit = materialised(find(docs).where("size(spans) > 0").select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1]), F.col("spans").alias(own[2])).dropDuplicates(own[:2]))
    joined = docs.join(small_or_shuffled(hit), F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.xxhash64("text") == F.col(own[1])), "left")
    masked = joined.withColumn("text", F.when(F.col(own[2]).isNotNull(), covered(F.col("text"), F.col(own[2]))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col(own[2]).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    """n_secret and n_spans (all spans) follow the columns of the contract."""
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    found = find(documents(spark, sf_dir))
    return found.select("doc_id", *[count("base", k) for k in range(BASE)], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), count("spans", BASE), F.size("spans").cast("long").alias("n_spans"))
