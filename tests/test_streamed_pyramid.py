"""A pyramid that follows a stream, against the batch mean of everything that was read."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quadrille.streaming import tiles

SCHEMA = "lon double, lat double, value double, ts timestamp"
START = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def replayed(spark, tmp_path_factory):
    """(cells, rows by batch): ten minutes of cells, a file a minute, and two files that move the time on."""
    rng = random.Random(23)
    folder = tmp_path_factory.mktemp("cells")
    cells = []
    for minute in range(12):
        at = START + datetime.timedelta(minutes=minute if minute < 10 else 60 * minute)
        part = [(rng.uniform(-170, 170), rng.choice([rng.uniform(-80, 80), 41.5]), float(rng.randrange(1000)) if rng.random() < 0.9 else None, at + datetime.timedelta(seconds=rng.randrange(50))) for _ in range(200 if minute < 10 else 1)]
        if minute >= 10:
            part = [(0.5, 0.5, 0.0, at)]
        cells += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    seen = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (
        tiles.refreshed(stream, 0, 4, 120_000, "5 minutes").writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        .foreachBatch(lambda df, k: seen.append([tuple(r) for r in df.collect()])).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.createDataFrame(cells, SCHEMA), seen


def test_last_rows_equal_the_batch(replayed):
    cells, seen = replayed
    last = {row[:3]: row[3:] for rows in seen for row in rows}
    # what closes the stream is not counted by the rows that it brings about
    early = cells.where(F.col("ts") < F.lit(START + datetime.timedelta(hours=1)))
    wanted = tiles.binned(early.where("value is not null"), 0, 4).groupBy("z", "x", "y").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).collect()
    assert len(wanted) > 200
    held = set(tiles.binned(cells.where(F.col("ts") >= F.lit(START + datetime.timedelta(hours=1))), 0, 4).select("z", "x", "y").distinct().toPandas().itertuples(index=False, name=None))
    for r in wanted:
        mean, n = last[r["z"], r["x"], r["y"]]
        if (r["z"], r["x"], r["y"]) in held:
            assert r["n"] <= n <= r["n"] + 2
        else:
            assert n == r["n"] and mean == pytest.approx(r["mean"], rel=1e-12)
    assert set(last) - held <= {(r["z"], r["x"], r["y"]) for r in wanted}


def test_changes_are_gathered(replayed):
    """The top tile changes with each file and is given out less often."""
    _, seen = replayed
    tops = [row for rows in seen for row in rows if row[:3] == (0, 0, 0)]
    assert 2 <= len(tops) < 10 and [t[4] for t in tops] == sorted(t[4] for t in tops)


def test_partials_add_up(spark):
    cells = spark.createDataFrame([(10.0, 50.0, 1.0, START), (10.0, 50.0, 3.0, START), (-100.0, -50.0, 5.0, START), (10.0, 50.0, None, START)], SCHEMA)
    sums = tiles.partials(cells, 0, 3).groupBy("z").agg(F.sum("total"), F.sum("n"), F.countDistinct("x", "y")).orderBy("z").collect()
    assert [tuple(r) for r in sums] == [(0, 9.0, 3, 1), (1, 9.0, 3, 2), (2, 9.0, 3, 2), (3, 9.0, 3, 2)]
    assert tiles.partials(cells.limit(0), 0, 3).count() == 0
