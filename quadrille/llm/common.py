"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only up to this many rows (a few MB for the narrow tables it is used on).
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; the setting is made here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file:///tmp/checkpoints/quadrille"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quadrille-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages neither recompute it nor
    depend on an executor that may be lost."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
