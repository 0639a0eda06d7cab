"""Trees of tiles with commit and abort, and the index of tile ids."""

import os

import pytest
from pyspark.sql import functions as F

from quadrille.plans import tileset
from quadrille.plans.options import TileError
from quadrille.sinks import tile_index, xyz

ABOUT = tileset.metadata_rows("demo", "png", (-10.0, -20.0, 30.0, 40.0), 0, 4)


def some(spark, z=4, text="t"):
    n = 2**z
    return spark.range(n * n).select(F.lit(z).alias("z"), (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"), F.encode(F.concat(F.lit(text), F.col("id").cast("string")), "utf-8").alias("data"))


def lost_later(batches):
    """Some tiles of a task are written before it fails."""
    for batch in batches:
        yield batch.slice(0, 5)
        raise RuntimeError("lost")


def files_of(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_tree_is_written_and_read(spark, tmp_path):
    root = str(tmp_path / "tree")
    assert xyz.write_xyz(some(spark), root, "png", ABOUT) == 256
    assert files_of(root) == sorted(["metadata.json"] + [f"4/{x}/{y}.png" for x in range(16) for y in range(16)])
    about, back = xyz.read_xyz(spark, root)
    assert about["scheme"] == "xyz" and about["maxzoom"] == 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, some(spark).collect()))
    assert back.rdd.getNumPartitions() == 16 and back.where("z = 4 and x in (3, 5)").rdd.getNumPartitions() == 2 and back.where("z = 4 and x = 3").count() == 16
    # others stay, the same are replaced
    assert xyz.write_xyz(some(spark, 1, "u").where("x = 0"), root, "png", ABOUT) == 2
    assert xyz.write_xyz(some(spark, 4, "v").where("x = 3 and y < 2"), root, "png", ABOUT) == 2
    assert len(files_of(root)) == 1 + 256 + 2
    with open(f"{root}/4/3/1.png") as f, open(f"{root}/4/3/2.png") as g:
        assert f.read() == "v19" and g.read() == "t35"
    assert xyz.write_xyz(some(spark, 1), root, "png", ABOUT, overwrite=True) == 4 and len(files_of(root)) == 5
    assert not [n for n in os.listdir(root) if n.startswith(".")]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "tree")
    broken = some(spark).withColumn("data", F.when((F.col("x") == 9) & (F.col("y") == 9), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    xyz.register(spark)
    os.makedirs(root)
    with pytest.raises(Exception, match="lost"):  # while tasks write
        broken.repartition(3, "x").withColumn("data", F.col("data")).write.format("xyz_tiles").mode("append").save(root)
    with pytest.raises(Exception, match="lost"):
        some(spark).mapInArrow(lost_later, xyz.TILES).write.format("xyz_tiles").mode("append").save(root)
    assert os.listdir(root) == []
    with pytest.raises(TileError):
        xyz.read_xyz(spark, str(tmp_path / "none"))


def test_attempts_that_do_not_count_are_not_moved(tmp_path):
    root = str(tmp_path)
    writer = xyz.XyzWriter(root, "png", None, False)
    for folder in ("good", "lost"):
        os.makedirs(f"{writer.staging}/{folder}/3/1")
        with open(f"{writer.staging}/{folder}/3/1/{len(folder)}.png", "w"):
            pass
    open(f"{writer.staging}/lost/3/1/9.png", "w").close()
    writer.commit([xyz.Written(f"{writer.staging}/good", 1), None])
    assert files_of(root) == ["3/1/4.png"]


def test_ids_are_one_run_of_numbers(spark):
    tiles = some(spark, 0).unionByName(some(spark, 1)).unionByName(some(spark, 2)).unionByName(some(spark, 3))
    ids = [(r["id"], tile_index.number(r["z"], r["x"], r["y"])) for r in tiles.select("*", tile_index.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("id")).collect()]
    assert sorted(a for a, _ in ids) == list(range(1 + 4 + 16 + 64)) and all(a == b for a, b in ids)
    far = spark.createDataFrame([(30, 2**30 - 1, 2**30 - 1), (30, 0, 2**30 - 1), (29, 2**29 - 1, 5)], "z int, x long, y long")
    assert all(r["id"] == tile_index.number(r["z"], r["x"], r["y"]) for r in far.select("*", tile_index.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("id")).collect())


def scanned(df):
    """Rows that the scan of a collected plan has given."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_a_point_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "index")
    heavy = some(spark, 6).withColumn("data", F.encode(F.concat(*[F.sha2(F.concat(F.col("x").cast("string"), F.lit(f"/{k}/"), F.col("y").cast("string")), 512) for k in range(16)]), "utf-8"))
    tile_index.write_index(heavy, path, group_bytes=1 << 16, partitions=2)
    found = tile_index.one_tile(spark, path, 6, 40, 21)
    assert [tuple(r)[:3] for r in found.collect()] == [(6, 40, 21)]
    assert scanned(found) <= 200 < 4096
    assert tile_index.one_tile(spark, path, 6, 64, 0).count() == 0


def test_batches_of_requests(spark, tmp_path):
    path = str(tmp_path / "index")
    tile_index.write_index(some(spark, 4), path)
    index = spark.read.parquet(path)
    asked = spark.createDataFrame([(1, 4, 0, 0), (2, 4, 3, 5), (2, 4, 3, 5), (3, 5, 0, 0), (4, None, 1, 1)], "k int, z int, x long, y long")
    got = tile_index.answered(index, asked)
    assert got.columns == ["k", "z", "x", "y", "data"]
    assert sorted((r["k"], r["data"] and bytes(r["data"])) for r in got.collect()) == [(1, b"t0"), (2, b"t83"), (2, b"t83"), (3, None), (4, None)]
    assert tile_index.answered(index, asked.where("k > 9")).count() == 0


def test_paths_of_requests(spark):
    paths = ["a/1/0/0.png", "a/1/0/0", "a/1/0/x", "a/1/0", "", "A-b_9/2/3/3.pbf.gz", "a b/1/1/1", "a/-1/0/0", "a/1.5/0/0", "zz/1/1/1"]
    asked = tile_index.parsed_requests(spark.createDataFrame([(p,) for p in paths], "path string"))
    index = some(spark, 1).unionByName(some(spark, 2)).withColumn("tile_id", tile_index.tile_id(F.col("z"), F.col("x"), F.col("y")))
    got = {r["path"]: (r["status"], r["content_type"], r["encoding"]) for r in tile_index.served({"a": ("webp", index), "A-b_9": ("pbf", index)}, asked).collect()}
    assert got["a/1/0/0.png"] == got["a/1/0/0"] == (200, "image/webp", None) and got["A-b_9/2/3/3.pbf.gz"] == (200, "application/x-protobuf", "gzip")
    assert {p: s[0] for p, s in got.items() if s[0] != 200} == {"a/1/0/x": 400, "a/1/0": 400, "": 400, "a/-1/0/0": 400, "a/1.5/0/0": 400, "a b/1/1/1": 404, "zz/1/1/1": 404}
