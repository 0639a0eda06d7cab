"""A tileset indexed by tile id, and batches of tile requests answered from it.

A tile's id numbers zooms one after another and the tiles of a zoom along a Z-curve, so neighbours lie
close together. The index is Parquet, dealt out by ranges of ids and sorted, with small row groups:
the statistics of a row group tell whether it may hold a tile, and a point read opens one of them. A
batch of requests is joined by id; where the requests leave gaps, their ranges reach the scan first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group.
GROUP_BYTES = 1 << 20
#: Ranges of ids that a batch's requests are put into for the scan.
RANGES = 64
#: Content types by format.
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "pbf": "application/x-protobuf"}
OTHER_TYPE = "application/octet-stream"


def spread(v: Column) -> Column:
    """A whole number's bits with a zero before each: its binary digits, read as digits of base 4."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Tiles of all lesser zooms come first, then those before it on the Z-curve; null outside the zoom."""
    side = F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))
    four = F.call_function("shiftleft", F.lit(1).cast("long"), (2 * z).cast("int"))
    lesser = (four - 1).bitwiseAND(F.lit(0x5555555555555555))  # a third of 4 ** z - 1: every other bit
    within = z.between(0, 30) & (x >= 0) & (x < side) & (y >= 0) & (y < side)
    return F.when(within, lesser + spread(x.cast("long")) + F.shiftleft(spread(y.cast("long")), 1))


def number(z: int, x: int, y: int) -> int | None:
    """The id of one tile, None outside the zoom."""
    if not (0 <= z <= 30 and 0 <= x < 1 << z and 0 <= y < 1 << z):
        return None
    bits = lambda v: sum((v >> k & 1) << 2 * k for k in range(z))
    return (4**z - 1) // 3 + bits(x) + 2 * bits(y)


def write_index(tiles: DataFrame, path: str, group_bytes: int = GROUP_BYTES, partitions: int | None = None) -> None:
    """(tile_id, z, x, y, data), sorted by id within files that hold ranges of ids."""
    numbered = tiles.select(tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"), "z", "x", "y", "data")
    dealt = numbered.repartitionByRange(partitions, "tile_id") if partitions else numbered.repartitionByRange("tile_id")
    dealt.sortWithinPartitions("tile_id").write.option("parquet.block.size", group_bytes).option("parquet.block.row.check.min", 16).parquet(path)


def one_tile(spark: SparkSession, path: str, z: int, x: int, y: int) -> DataFrame:
    """The tile of a place, or no row; row groups that can't hold its id are not read."""
    return spark.read.parquet(path).where(F.col("tile_id") == number(z, x, y)).select("z", "x", "y", "data")


def id_ranges(ids: DataFrame, parts: int = RANGES) -> list[tuple[int, int]]:
    """Least and greatest id of each of some equally full parts of the requests; a bounded number of rows."""
    cuts = ids.agg(F.percentile_approx("tile_id", [k / parts for k in range(1, parts)], 1000).alias("cuts")).first()["cuts"]
    if not cuts:
        return []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("tile_id")))
    return sorted((r["a"], r["b"]) for r in ids.groupBy(part.alias("part")).agg(F.min("tile_id").alias("a"), F.max("tile_id").alias("b")).collect())


def answered(index: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (with z, x and y) and the ``data`` of each, null where the index has no such tile."""
    wanted = requests.withColumn("tile_id", tile_id(F.col("z"), F.col("x"), F.col("y")))
    spans = id_ranges(wanted.where("tile_id is not null").select("tile_id"))
    within = F.lit(False)
    for a, b in spans:
        within = within | F.col("tile_id").between(a, b)
    return wanted.join(index.where(within).select("tile_id", "data"), "tile_id", "left").drop("tile_id")


def parsed_requests(requests: DataFrame, path: str = "path") -> DataFrame:
    """Requests with layer, z, x, y from paths ``layer/z/x/y``; y may have an extension. What isn't whole is null."""
    part = lambda k: F.get(F.split(path, "/"), F.lit(k))
    whole = lambda c: F.when(F.rlike(c, F.lit(r"^[0-9]{1,18}$")), c.cast("long"))
    return requests.withColumns({"layer": F.coalesce(part(0), F.lit("")), "z": whole(part(1)).try_cast("int"), "x": whole(part(2)), "y": whole(F.get(F.split(part(3), "[.]"), F.lit(0)))})


def served(layers: dict[str, tuple[str, DataFrame]], requests: DataFrame) -> DataFrame:
    """Parsed requests with status, content_type, encoding and data. ``layers``: format and index of each name.

    400: z, x or y is no whole number; 404: no such layer, or a name of other characters than letters,
    digits, - and _; 204: no such tile; else 200, where pbf tiles are gzipped."""
    out = None
    whole = F.col("z").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    safe = F.rlike("layer", F.lit("^[A-Za-z0-9_-]+$"))
    none = F.lit(None).cast("string")
    known = whole & safe & F.col("layer").isin(*layers)
    bad = requests.where(~F.coalesce(known, F.lit(False))).select("*", F.when(~whole, 400).otherwise(404).alias("status"), none.alias("content_type"), none.alias("encoding"), F.lit(None).cast("binary").alias("data"))
    for name, (fmt, index) in layers.items():
        mine = answered(index, requests.where(known & (F.col("layer") == name)))
        found = F.col("data").isNotNull()
        mine = mine.select(*requests.columns, F.when(found, 200).otherwise(204).alias("status"), F.when(found, TYPES.get(fmt, OTHER_TYPE)).alias("content_type"), F.when(found & F.lit(fmt == "pbf"), "gzip").alias("encoding"), "data")
        out = mine if out is None else out.unionByName(mine)
    return bad if out is None else bad.unionByName(out)
