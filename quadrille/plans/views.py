"""Geospatial views derived from the test tables, by the same SQL in Spark and elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .options import RasterMeta

PTS = """select c_custkey k, ((c_custkey*7919)%36000)/cast(100 as double)-180 lon,
       ((c_custkey*104729)%17000)/cast(100 as double)-85 lat from customer"""
GRID = """select cast(floor(o_orderkey/128) as bigint) r, o_orderkey%128 c,
       case when o_orderstatus='P' then null else o_totalprice end v from orders"""
RGB = """select cast(floor(o_orderkey/128) as bigint) r, o_orderkey%128 c,
       cast(floor(o_totalprice) as bigint)%256 b1, case when o_orderstatus='P' then null else o_custkey%256 end b2,
       o_orderkey%256 b3, o_orderkey%200 b4 from orders"""
BOXES = """select s_suppkey k, ((s_suppkey*7919)%34000)/cast(100 as double)-175 lon,
       ((s_suppkey*104729)%15000)/cast(100 as double)-75 lat, cast(0.5 as double)+(s_suppkey%7) w from supplier"""
TRACKS = """select user_id k, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) ord,
       ((event_id*7919)%20000)/cast(10000 as double)-72 lon, ((event_id*104729)%20000)/cast(10000 as double)-34 lat from events"""
PROPS = """select event_type layer, event_id ord, 'v' k, case when event_id%2=0 then 'Number' else 'String' end t from events
union all select event_type, event_id, 'n', case when event_id%3=0 then null else 'Boolean' end from events"""
#: Origin, cell size and width of the grid and rgb views.
ORIGIN_X, ORIGIN_Y, CELL, COLS = -71.5137, -32.8071, 0.002, 128


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """``sql`` over tables of the folder."""
    for t in tables:
        sql = sql.replace(f" from {t}", f" from {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def grid(spark: SparkSession, sf_dir: str) -> tuple[RasterMeta, DataFrame]:
    cells = view(spark, sf_dir, GRID, "orders").select(F.lit(1).alias("band"), F.col("r").alias("row"), F.col("c").alias("col"), F.col("v").alias("value"))
    rows = cells.agg(F.max("row")).first()[0] + 1
    return RasterMeta(rows, COLS, ORIGIN_X, ORIGIN_Y, CELL, CELL), cells


def rgb(spark: SparkSession, sf_dir: str) -> tuple[RasterMeta, DataFrame]:
    wide = view(spark, sf_dir, RGB, "orders")
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"b{k}").cast("double").alias("value")) for k in (1, 2, 3, 4)]))
    cells = wide.select(F.col("r").alias("row"), F.col("c").alias("col"), bands.alias("b")).select("b.band", "row", "col", "b.value")
    rows = cells.agg(F.max("row")).first()[0] + 1
    return RasterMeta(rows, COLS, ORIGIN_X, ORIGIN_Y, CELL, CELL, bands=4), cells


def _feature(df: DataFrame, layer: str, order: int, ord_: str, kind: str, parts) -> DataFrame:
    from ..operators.vector import PROP

    props = F.array(F.struct(F.lit("k").alias("k"), F.lit("Int").alias("t"), F.lit(None).cast("boolean").alias("b"), F.col(ord_).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("string").alias("s"))).cast(PROP)
    return df.select(F.lit(layer).alias("layer"), F.lit(order).alias("layer_ord"), F.col(ord_).cast("long").alias("feature_ord"), F.lit(kind).alias("kind"), parts.alias("parts"), F.col(ord_).cast("decimal(20,0)").alias("id"), props.alias("props"))


def point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(view(spark, sf_dir, PTS, "customer"), "pts", 0, "k", "Point", F.array(F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))))


def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda dx, dy: F.struct((F.col("lon") + dx * F.col("w")).alias("x"), (F.col("lat") + dy * F.col("w")).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return _feature(view(spark, sf_dir, BOXES, "supplier"), "boxes", 1, "k", "Polygon", F.array(F.array(ring)))


def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(F.array_sort(F.collect_list(F.struct("ord", "lon", "lat"))), lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))
    lines = view(spark, sf_dir, TRACKS, "events").groupBy("k").agg(points.alias("line"))
    return _feature(lines, "tracks", 2, "k", "LineString", F.array(F.array(F.col("line"))))
