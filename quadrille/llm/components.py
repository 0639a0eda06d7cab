"""Connected components over a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, comp): comp is the smallest id that links (a, b) reach from id. Ids without links are left out.

    Each round takes the smallest label of all neighbours and then follows labels once more, so
    stars end in two rounds and chains in about the logarithm of their length. Minima are
    pre-aggregated, so a node with many neighbours does not gather them in a task. Tables are
    written to the shared folder each round.
    """
    both = materialised(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialised(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    for _ in range(most_rounds):
        known = labels.withColumnsRenamed({"id": "b", "comp": "c"})
        near = both.join(known, "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        stepped = labels.join(near, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = materialised(stepped.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        labels = new.select("id", "comp")
        if not new.where("comp <> old").limit(1).count():
            return labels
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
