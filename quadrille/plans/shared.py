"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; the setting is made here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file:///tmp/checkpoints/quadrille"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tiles-{uuid.uuid4().hex}"


def shared_path(spark: SparkSession) -> str:
    """A new folder there as a path of the file system, for what is no table."""
    folder = shared_folder(spark).removeprefix("file://")
    os.makedirs(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: computed once, whatever executors are lost."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
