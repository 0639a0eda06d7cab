"""Cloud Optimized GeoTIFF: levels and blocks are made by Spark and written to the shared folder once; the
driver lays out the file from the blocks' sizes, and tasks put the blocks at their places."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import tiff
from ..operators import raster
from ..plans.options import CogOptions, RasterMeta, TileError
from .files import in_order, write_rows


def levels_of(meta: RasterMeta, tile_size: int) -> list[tuple[int, int]]:
    """(rows, cols) of each level."""
    out = [(meta.rows, meta.cols)]
    while max(out[-1]) > tile_size:
        out.append((-(-out[-1][0] // 2), -(-out[-1][1] // 2)))
    return out


def blocks(cells: DataFrame, meta: RasterMeta, options: CogOptions = CogOptions(), nodata: float | None = None) -> DataFrame:
    """(level, block_row, block_col, data): every block of every level, empty ones filled."""
    ts, bands, deflate = options.tile_size, meta.bands, options.deflate
    lo, hi = options.stretch or (0.0, 255.0)
    levels = raster.overviews(cells, meta.rows, meta.cols, ts)
    placed = levels.select("level", F.floor(F.col("row") / ts).alias("block_row"), F.floor(F.col("col") / ts).alias("block_col"), "band", (F.col("row") % ts).cast("int").alias("i"), (F.col("col") % ts).cast("int").alias("j"), "value")
    # a block without cells is still in the file
    frame = None
    for k, (rows, cols) in enumerate(levels_of(meta, ts)):
        down, across = -(-rows // ts), -(-cols // ts)
        level = cells.sparkSession.range(down * across).select(F.lit(k).alias("level"), F.floor(F.col("id") / across).alias("block_row"), (F.col("id") % across).alias("block_col"))
        frame = level if frame is None else frame.unionByName(level)
    frame = frame.select("*", F.lit(0).alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("double").alias("value"))
    fill = np.nan if nodata is None else nodata

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[(rows["band"] > 0) & rows["value"].notna()]
        at = rows["i"], rows["j"], rows["band"] - 1
        if bands == 1:
            data = np.full((ts, ts, 1), fill, np.float32)
            data[at] = rows["value"]
        else:
            data = np.zeros((ts, ts, bands), np.uint8)
            data[at] = np.clip((rows["value"] - lo) * (1 / (hi - lo)) * 255, 0, 255).astype(np.uint8)
        raw = data.tobytes()
        return pd.DataFrame({"level": [key[0]], "block_row": [key[1]], "block_col": [key[2]], "data": [zlib.compress(raw) if deflate else raw]})

    return placed.unionByName(frame).groupBy("level", "block_row", "block_col").applyInPandas(pack, "level int, block_row long, block_col long, data binary")


def own_crs(epsg: int | None, override: str | None = None) -> str:
    """The CRS that the file's keys name: an override, else the EPSG code; bounds are not asked."""
    crs = override or {4326: "4326", 3857: "3857", 900913: "3857"}.get(epsg)
    if crs not in ("4326", "3857"):
        raise TileError(f"a COG is written in EPSG 4326 or 3857, not {override or epsg}")
    return crs


def write_cog(cells: DataFrame, meta: RasterMeta, path: str, options: CogOptions = CogOptions(), nodata: float | None = None) -> dict:
    """Writes the file; returns its levels, tiles and bytes."""
    made = in_order(blocks(cells, meta, options, nodata), [F.desc("level"), "block_row", "block_col"])
    sizes: dict[int, list[int]] = {}  # the directories list every block; a classic TIFF holds 4 GiB
    for b in made.select("level", F.octet_length("data").alias("n"), "block_row", "block_col").orderBy("level", "block_row", "block_col").toLocalIterator():
        sizes.setdefault(b["level"], []).append(b["n"])
    levels = [{"rows": r, "cols": c, "sizes": sizes[k]} for k, (r, c) in enumerate(levels_of(meta, options.tile_size))]
    text = None if meta.bands > 1 else "nan" if nodata is None else repr(float(nodata)).removesuffix(".0")
    head = tiff.cog(levels, meta, meta.bands, meta.bands == 1, options.tile_size, options.deflate, text)
    return {"levels": len(levels), "tiles": sum(map(len, sizes.values())), "bytes": write_rows(made, path, head)}
