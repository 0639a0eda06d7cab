"""Tilesets to Parquet and MBTiles.

Tasks write; the driver only joins what they have written. MBTiles files are made for a folder that
all executors share. Trees of tiles are ``sinks.xyz``.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid

from pyspark.sql import DataFrame

from ..functions import mercator as M


def write_parquet(tiles: DataFrame, path: str) -> None:
    tiles.repartition("z", "x").write.mode("overwrite").partitionBy("z").parquet(path)


def write_mbtiles(tiles: DataFrame, path: str, metadata: list[tuple[str, str]]) -> int:
    """An MBTiles file: tasks write SQLite shards beside it, the driver attaches and renames. Rows are TMS."""
    shards = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(shards)
    ddl = "create table tiles(zoom_level integer, tile_column integer, tile_row integer, tile_data blob)"

    def put(rows):
        import pyarrow as pa

        shard, n = f"{shards}/{uuid.uuid4().hex}", 0
        with sqlite3.connect(shard) as db:
            db.execute("pragma journal_mode=off")
            db.execute("pragma synchronous=off")
            db.execute(ddl)
            for batch in rows:
                db.executemany("insert into tiles values (?, ?, ?, ?)", zip(*(batch.column(c).to_pylist() for c in ("z", "x", "row", "data"))))
                n += len(batch)
        db.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n])], ["shard", "n"])

    try:
        made = tiles.select("z", "x", M.tms_row("z", "y").alias("row"), "data").mapInArrow(put, "shard string, n long").collect()  # a row per task
    except BaseException:
        shutil.rmtree(shards, ignore_errors=True)
        raise
    whole = f"{shards}/whole"
    db = sqlite3.connect(whole, isolation_level=None)
    try:
        for statement in ("pragma journal_mode=off", "pragma synchronous=off", "create table metadata(name text, value text)", ddl):
            db.execute(statement)
        for r in made:  # only shards of tasks that ended well
            db.execute("attach ? as shard", (r["shard"],))
            db.execute("insert into tiles select * from shard.tiles")
            db.execute("detach shard")
        db.execute("create unique index tile_index on tiles(zoom_level, tile_column, tile_row)")
        db.executemany("insert into metadata values (?, ?)", metadata)
    finally:
        db.close()
    os.replace(whole, path)
    shutil.rmtree(shards)
    return sum(r["n"] for r in made)
