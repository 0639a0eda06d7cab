"""Mixing sources to target weights by Poisson replication.

Each document of source ``s`` is repeated ``Poisson(rate_s)`` times, with
``rate_s = size * weight_s / documents_s``. The draw inverts the Poisson distribution at a uniform
number taken from a hash of the seed and the document's id, so the count does not depend on
partitioning, retries or the order of rows. The copies are dealt out by a hash of id and copy and
sorted by it, which is a global shuffle.

Defined results: a null source is a source of its own; a source without a weight has weight 0; a
document with a null id draws by its text (null taken as empty); repeated rows draw alike; null or
empty text does not matter otherwise; an empty table gives an empty table. Input columns called ``mix_copy`` or ``mix_order``
are replaced; columns of any other name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, small_or_shuffled

SEED = 17
#: Without given weights they are proportional to the number of documents to this power.
TEMPERATURE = 0.5


def hash48(*parts: Column) -> Column:
    """The first 48 bits of an MD5 over the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def drawn_by(docs: DataFrame) -> Column:
    """What a document's draw is made from: its id, or without one its text."""
    text = F.coalesce("text", F.lit("")) if "text" in docs.columns else F.lit("")
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text)))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, size: int | None = None) -> DataFrame:
    """(source, rate): the mean number of repeats that brings each source to its weight."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        weighed = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    all_weight, all_docs = weighed.agg(F.sum("w"), F.sum("n")).first()
    return weighed.select("source", (F.lit(float(size or all_docs or 0)) * (F.col("w") / F.lit(all_weight or 1.0)) / F.col("n")).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, steps): steps[k] is the chance of at most k repeats, carried far into the tail."""
    by_source = Window.partitionBy("source").orderBy("k")
    k = F.col("k").cast("double")
    terms = rates.where("rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int"))))
    chance = terms.withColumn("lf", F.sum(F.ln(F.greatest(k, F.lit(1.0)))).over(by_source)).withColumn("p", F.exp(k * F.ln("rate") - F.col("rate") - F.col("lf")))
    steps = chance.withColumn("c", F.sum("p").over(by_source)).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x.c).alias("steps"))
    return steps


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, size: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents, each repeated by its draw, in a global random order; adds mix_copy and mix_order.

    There is a row of ``steps`` for each source; it is broadcast if counted to be few rows, else
    Spark joins by shuffle, where adaptive execution splits a hot source.
    """
    names = [c for c in docs.columns if c not in ("mix_copy", "mix_order")]
    own = {c: free_name(docs, c) for c in ("rate_source", "steps", "draw", "repeats", "spread")}
    steps = small_or_shuffled(poisson_steps(source_rates(docs, weights, size)).withColumnsRenamed({"source": own["rate_source"], "steps": own["steps"]}))
    doc = drawn_by(docs)
    uniform = hash48(F.lit(str(seed)), doc) / F.lit(float(2**48))
    drawn = (
        docs.select(*names).withColumn(own["draw"], uniform)
        .join(steps, F.col("source").eqNullSafe(F.col(own["rate_source"])))
        .withColumn(own["repeats"], F.size(F.filter(own["steps"], lambda c: c <= F.col(own["draw"]))))
        .where(F.col(own["repeats"]) > 0)
        .select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own["repeats"]).cast("long"))).alias("mix_copy"))
    )
    dealt = drawn.withColumn("mix_order", hash48(F.lit(str(seed)), doc, F.col("mix_copy").cast("string")))
    # rows without an id, or with the same one, have one order value; their texts spread them
    dealt = dealt.withColumn(own["spread"], F.xxhash64(*[c for c in ("mix_order", "text") if c in dealt.columns], F.spark_partition_id()))
    return dealt.repartition(own["spread"]).sortWithinPartitions("mix_order", "mix_copy").drop(own["spread"])


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return mix(documents(spark, sf_dir))


SQL = f"""
with counts as (select source, count(*)::double n from documents group by source),
rates as (select source, (select sum(n) from counts) * (pow(n, {TEMPERATURE}) / (select sum(pow(n, {TEMPERATURE})) from counts)) / n rate from counts),
terms as (select source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::int)) k from rates),
chances as (select source, k, exp(k::double * ln(rate) - rate - sum(ln(greatest(k, 1)::double)) over (partition by source order by k)) p from terms),
steps as (select source, k, sum(p) over (partition by source order by k) c from chances),
drawn as (select d.*, (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, 'null:' || md5(coalesce(d.text, '')))), 1, 12))::bigint)::double / 281474976710656.0 u from documents d),
counted as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, (select count(*) from steps s where s.source is not distinct from d.source and s.c <= d.u) n from drawn d),
copies as (select doc_id, text, lang, source, n_chars, unnest(generate_series(1, n)) mix_copy from counted where n > 0)
select *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, ''))) || ':' || mix_copy::varchar), 1, 12))::bigint mix_order from copies
"""
