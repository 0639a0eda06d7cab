"""Filter interaction audit: what every order of a set of filters would keep, remove and lose.

A document's fate under any order depends only on the set of filters that it fails. So documents
are counted once, by part and failure mask, in at most ``2 ** filters`` cells a part; all orders are
then read off the cells. Orders are visited by swaps of two neighbours (plain changes), so that a
visit computes only the two steps whose filter or predecessors changed; the other steps stand as
they were. A filter's removals are added up along the walk: the Shapley value times the number of
orders.

A filter is a name and a condition of failure. Conditions on the row itself are Columns over
``words`` (the text's words) and ``body`` (the text, null taken as empty). Being a copy of another
document is no condition on the row; ``COPY`` stands for it. Copies are told from their first
document without a join: rows of one text are counted by id, part and labels, and only the rows of
the smallest id pass.

Defined results: a null text is empty, and equal to empty texts; a null part is the empty string;
rows without an id have no smaller id, and are no smaller id to others; rows with the same id and
text are no copies of each other, and each of them counts; a document with several labels is good or
toxic if one of them says so; null labels say nothing. An empty table gives no rows. Columns of
other names in either table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

COPY = "copy of a smaller id's text"
#: The walk has factorial(filters) visits.
MOST_FILTERS = 8
SPACE = r"[\x20\x09-\x0D]+"
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def contract_filters() -> dict[str, Column | str]:
    words, body = F.col("words"), F.col("body")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))) > 10 * F.length(body),
        "D": body.rlike(r"[#$%&*|]"),
        "E": COPY,
    }


def failures(docs: DataFrame, filters: dict[str, Column | str], part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, body_key) of every row; bit k of mask: the k-th filter fails by the row alone."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body"))
    split = plain.withColumn("words", F.array_remove(F.split("body", SPACE), ""))
    mask = F.lit(0)
    for k, failing in enumerate(filters.values()):
        if not isinstance(failing, str):
            mask = mask + F.when(failing, 1 << k).otherwise(0)
    return split.select("doc_id", "part", mask.alias("mask"), F.sha2("body", 256).alias("body_key"))


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str], part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows that fail just the filters of mask, and how many of them are labelled so."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have more than {math.factorial(MOST_FILTERS)} orders")
    copies = sum(1 << k for k, failing in enumerate(filters.values()) if isinstance(failing, str))
    flags = labels.select(F.col("doc_id").cast("string").alias("label_key"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where("label_key is not null")
    flags = flags.groupBy("label_key").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    # rows without an id meet no label; their texts deal them out
    rows = failures(docs, filters, part).withColumn("row_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), "body_key")))
    rows = rows.join(flags, F.col("row_key") == F.col("label_key"), "left").withColumns({"good": F.coalesce("q", F.lit(False)), "toxic": F.coalesce("t", F.lit(False))})
    kind = ["part", "mask", "good", "toxic"]
    by_id = rows.groupBy("row_key", "doc_id", "body_key", *kind).agg(F.count(F.lit(1)).alias("n"))
    # a text of a third of all rows leaves a row for each kind and task here
    by_text = by_id.groupBy("body_key", *kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_free"))
    first = by_text.withColumn("first", F.min("least").over(Window.partitionBy("body_key")))
    passing = F.col("n_free") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), passing.alias("c")), F.struct((F.col("mask") + copies).alias("m"), (F.col("n") - passing).alias("c"))))
    cells = (first.select("part", "good", "toxic", both.alias("x")) if copies else first.select("part", "good", "toxic", F.struct(F.col("mask").alias("m"), F.col("n").alias("c")).alias("x"))).where("x.c > 0")
    return cells.groupBy("part", F.col("x.m").alias("mask")).agg(F.sum("x.c").alias("n"), F.sum(F.when(F.col("good"), F.col("x.c")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("x.c")).otherwise(0)).alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places i, such that swapping i and i + 1 one after another visits every order of n once."""
    if n < 2:
        return
    inner, down = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)  # the last item stands at an end, and the others go on by one swap
        if at is None:
            return
        yield at + down
        down = not down


def clear_of(cells: np.ndarray) -> np.ndarray:
    """cells[m]: how many fail just m. For each set s, how many fail none of s."""
    within = cells.copy()  # how many fail a subset of m
    for k in range(len(cells).bit_length() - 1):
        has = np.flatnonzero(np.arange(len(cells)) >> k & 1)
        within[has] += within[has ^ 1 << k]
    return within[::-1].copy()  # those that fail a subset of the complement of s


def walk(names: list[str], mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> pd.DataFrame:
    """A row for each order and step, from the mask cells of one part."""
    k, size = len(names), 1 << len(names)
    clear = []
    for counts in (n, good, toxic):
        cells = np.zeros(size, np.int64)
        np.add.at(cells, mask, counts)
        clear.append(clear_of(cells))
        if counts is n:
            alone = [int(cells[1 << f]) for f in range(k)]
    fails = [int(clear[0][0] - clear[0][1 << f]) for f in range(k)]

    def step(before: int, f: int) -> tuple[int, ...]:
        lost = [int(c[before] - c[before | 1 << f]) for c in clear]
        return int(clear[0][before | 1 << f]), lost[0], fails[f] - lost[0], alone[f], lost[1], lost[2]

    order, before = list(range(k)), [(1 << i) - 1 for i in range(k)]
    steps = [step(before[i], f) for i, f in enumerate(order)]
    orders, rows, total = [], [], [0] * k

    def visit() -> None:
        orders.extend(["".join(names[f] for f in order)] * k)
        for f, s in zip(order, steps):
            rows.append((f, *s))
            total[f] += s[1]

    visit()
    for i in plain_changes(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        steps[i], steps[i + 1] = step(before[i], order[i]), step(before[i + 1], order[i + 1])
        visit()
    table = np.array(rows, np.int64).reshape(-1, 7)
    out = pd.DataFrame({"filter_order": orders, "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows) // k)})
    for j, c in enumerate(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")):
        out[c] = table[:, j + 1]
    out["shapley"] = np.array(total, np.int64)[table[:, 0]]
    return out


def audit(cells: DataFrame, names: list[str]) -> DataFrame:
    """All orders and steps of each part. A part has 2 ** filters cells at most, so a group is bounded."""

    def orders(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = walk(names, *(part[c].to_numpy() for c in ("mask", "n", "good", "toxic")))
        out.insert(0, "part", key[0])
        return out

    return cells.groupBy("part").applyInPandas(orders, STEPS)


def op11(spark, sf_dir: str) -> DataFrame:
    filters = contract_filters()
    return audit(mask_cells(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), filters), list(filters))


#: Every order from its letters, and every step from the filters before it: no walk.
SQL = r"""
with split as (select doc_id, coalesce(lang, '') part, coalesce(text, '') body, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') words from documents),
least as (select body, min(doc_id) least from split group by body),
flags as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
judged as (select s.part, coalesce(f.good, false) good, coalesce(f.toxic, false) toxic, (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
  + 4 * (100 * (length(s.body) - length(regexp_replace(s.body, '[A-Z]', '', 'g'))) > 10 * length(s.body))::int + 8 * regexp_matches(s.body, '[#$%&*|]')::int + 16 * coalesce(s.doc_id > l.least, false)::int mask
  from split s join least l on s.body = l.body left join flags f on s.doc_id = f.doc_id),
cells as (select part, mask, count(*) n, count(*) filter (where good) good, count(*) filter (where toxic) toxic from judged group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) l, unnest([1, 2, 4, 8, 16]) b),
orders as (select a.l || b.l || c.l || d.l || e.l filter_order, [a.b, b.b, c.b, d.b, e.b] bits from f a, f b, f c, f d, f e where (a.b | b.b | c.b | d.b | e.b) = 31),
steps as (select filter_order, step, bits[step] b, list_sum([0] || bits[1:step - 1])::int before from orders, (select unnest([1, 2, 3, 4, 5])::int step)),
counted as (select part, filter_order, step, b, sum(n) filter (where mask & (before | b) = 0) kept, sum(n) filter (where mask & b <> 0 and mask & before = 0) removed, sum(n) filter (where mask & b <> 0 and mask & before <> 0) redundant,
  sum(n) filter (where mask = b) unique_fails, sum(good) filter (where mask & b <> 0 and mask & before = 0) good_lost, sum(toxic) filter (where mask & b <> 0 and mask & before = 0) toxic_lost from cells, steps group by all),
whole as (select part, filter_order, step, b, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost from counted)
select * exclude (b), (sum(removed) over (partition by part, b))::bigint shapley from whole
"""
