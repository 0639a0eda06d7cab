"""Trees of tiles, ``root/z/x/y.extension``, as a data source that writes and reads.

``tiles.write.format("xyz_tiles").option("extension", "png").save(root)``: each attempt of a task writes
below a staging folder of its own. When all have ended well, the driver moves what the attempts that
count have written into the tree, whole folders where it has none of that name; a job that fails
removes its staging folder, and nothing of it was visible. ``append`` replaces tiles of the same
place and keeps others, ``overwrite`` replaces the tree. Needs a folder that driver and executors share.

Reading gives (z, x, y, data), a partition for each column of tiles, and only those columns whose zoom
and x the filters allow.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..plans.options import TileError

TILES = "z int, x long, y long, data binary"
ABOUT = "metadata.json"
#: Tiles of a column that one task writes.
COLUMN_TILES = 4096


@dataclass
class Written(D.WriterCommitMessage):
    """What one attempt has written."""

    folder: str
    tiles: int


class XyzWriter(D.DataSourceArrowWriter):
    def __init__(self, root: str, extension: str, about: str | None, overwrite: bool):
        self.root, self.extension, self.about, self.overwrite = root, extension, about, overwrite
        self.staging = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own, n, made = f"{self.staging}/{uuid.uuid4().hex}", 0, set()
        os.makedirs(own)
        for batch in iterator:
            for z, x, y, data in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y", "data"))):
                if (z, x) not in made:
                    os.makedirs(f"{own}/{z}/{x}", exist_ok=True)
                    made.add((z, x))
                with open(f"{own}/{z}/{x}/{y}.{self.extension}", "wb") as f:
                    f.write(data)
                n += 1
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            old = f"{self.staging}/old"
            os.makedirs(old)
            for name in os.listdir(self.root):
                if not name.startswith("."):
                    os.rename(f"{self.root}/{name}", f"{old}/{name}")
        for message in messages:
            if message:
                merge(message.folder, self.root)
        if self.about:
            with open(f"{self.staging}-about", "w") as f:
                f.write(self.about)
            os.replace(f"{self.staging}-about", f"{self.root}/{ABOUT}")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def merge(source: str, target: str) -> None:
    """Moves what ``source`` holds into ``target``: folders whole where there are none of that name."""
    os.makedirs(target, exist_ok=True)
    for name in os.listdir(source):
        a, b = f"{source}/{name}", f"{target}/{name}"
        if os.path.isdir(a) and os.path.isdir(b):
            merge(a, b)
        else:
            os.replace(a, b)


class Columns(D.InputPartition):
    def __init__(self, folders: list[tuple[int, int]]):
        super().__init__(len(folders))
        self.folders = folders


class XyzReader(D.DataSourceReader):
    def __init__(self, root: str):
        self.root, self.only = root, {}

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if isinstance(f, (D.EqualTo, D.In)) and f.attribute in (("z",), ("x",)):
                values = {f.value} if isinstance(f, D.EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            yield f

    def partitions(self) -> list[Columns]:
        number = lambda folder, c: sorted(v for v in (int(n) for n in os.listdir(folder) if n.isdigit()) if v in self.only.get(c, (v,)))
        return [Columns([(z, x)]) for z in number(self.root, "z") for x in number(f"{self.root}/{z}", "x")]

    def read(self, partition: Columns | None) -> Iterator[pa.RecordBatch]:
        for z, x in partition.folders if partition else ():
            names = sorted(n for n in os.listdir(f"{self.root}/{z}/{x}") if n.partition(".")[0].isdigit())
            for k in range(0, len(names), 256):
                rows = []
                for name in names[k : k + 256]:
                    with open(f"{self.root}/{z}/{x}/{name}", "rb") as f:
                        rows.append((int(name.partition(".")[0]), f.read()))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([z] * n, pa.int32()), pa.array([x] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["z", "x", "y", "data"])


class XyzTiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "xyz_tiles"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> XyzReader:
        return XyzReader(self.options["path"].removeprefix("file://"))

    def writer(self, schema, overwrite: bool) -> XyzWriter:
        root = self.options["path"].removeprefix("file://")
        os.makedirs(root, exist_ok=True)
        return XyzWriter(root, self.options.get("extension", "png"), self.options.get("about"), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XyzTiles)


def write_xyz(tiles: DataFrame, root: str, extension: str, metadata: list[tuple[str, str]], overwrite: bool = False) -> int:
    """The tree and metadata.json; existing tiles are replaced, others stay unless ``overwrite``. Returns the number written."""
    from ..plans.tileset import observed, progress

    register(tiles.sparkSession)
    named = dict(metadata)
    about = {"name": named["name"], "format": named["format"], "minzoom": int(named["minzoom"]), "maxzoom": int(named["maxzoom"]), "bounds": [float(v) for v in named["bounds"].split(",")], "scheme": "xyz"}
    about |= {"json": named["json"]} if "json" in named else {}
    # a task has whole columns of tiles, so that folders are moved whole
    dealt = tiles.select("z", "x", "y", "data").repartition("z", "x", F.floor(F.col("y") / COLUMN_TILES))
    made, seen = observed(dealt, range(31))
    made.write.format("xyz_tiles").option("extension", extension).option("about", json.dumps(about)).mode("overwrite" if overwrite else "append").save(root)
    return sum(r["written"] for r in progress(seen))


def read_xyz(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """metadata.json, and the tiles of a tree."""
    register(spark)
    try:
        with open(f"{root.removeprefix('file://')}/{ABOUT}") as f:
            about = json.load(f)
    except FileNotFoundError:
        about = {}
    if not os.path.isdir(root.removeprefix("file://")):
        raise TileError(f"no tree of tiles at {root}")
    return about, spark.read.format("xyz_tiles").load(root)
