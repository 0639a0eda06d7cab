"""GeoTIFF by block: a data source whose partitions are strips or tiles, read by range.

``spark.read.format("geotiff_blocks").load(path)`` gives (band, row, col, value). The driver reads the
directory alone, by range. Comparisons of band, row and col with constants reach the source, where
``register`` has made Spark offer them: blocks that can't hold an answer are no partitions, and bands
that aren't asked for are not decoded into rows. Options: ``bands`` (comma-separated, numbered from 1
in the order given), ``partitions`` (most partitions, beyond which neighbouring blocks share one).

Files are opened by Arrow's file systems (local, S3, GCS, HDFS), since tasks of a Python source
have no access to Hadoop's; ``readers.read_geotiff`` reads whole files from any store that Spark knows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..codecs import tiff
from ..operators import raster
from ..plans.options import RasterMeta, TileError
from .ranges import RangeFile

CELLS = "band int, row long, col long, value double"
MOST_PARTITIONS = 20_000


def grid_of(tags: dict[int, tuple], bands: int, crs: str | None = None) -> RasterMeta:
    """The grid that a directory describes."""
    ox, oy, pw, ph = tiff.geo(tags)
    h, w = tags[tiff.HEIGHT][0], tags[tiff.WIDTH][0]
    return RasterMeta(h, w, ox, oy, pw, ph, raster.detect_crs((ox, oy - h * ph, ox + w * pw, oy), tiff.epsg(tags), crs), bands)


def missing_value(tags: dict[int, tuple]) -> float | None:
    """What stands for missing values, besides NaN."""
    text = tags.get(tiff.NODATA, ("",))[0].strip()
    value = float(text) if text else math.nan
    return None if math.isnan(value) else value


class BlockPartition(D.InputPartition):
    def __init__(self, blocks: list[tiff.Block]):
        super().__init__(len(blocks))
        self.blocks = blocks


class BlockReader(D.DataSourceReader):
    def __init__(self, path: str, bands: list[int] | None, most: int):
        self.path, self.most = path, most
        self.order, tags = tiff.directory(RangeFile(path))
        count = tags.get(tiff.SAMPLES, (1,))[0]
        self.bands = bands or list(range(1, count + 1))
        if any(not 1 <= b <= count for b in self.bands):
            raise TileError(f"bands {self.bands} of {count}")
        self.nodata, self.tags = missing_value(tags), tags
        self.coding, _ = tiff.layout(self.order, tags)
        #: What filters leave of each column: least and greatest.
        self.within = {"row": [0, tags[tiff.HEIGHT][0] - 1], "col": [0, tags[tiff.WIDTH][0] - 1], "band": [1, len(self.bands)]}

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Narrows what is read; Spark applies the filters to the rows again, as blocks hold more."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in self.within:
                low, high = self.within[column]
                # rows, columns and bands are whole numbers, and Spark casts what they are compared with
                if isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, D.GreaterThan))
                elif isinstance(f, (D.LessThan, D.LessThanOrEqual)):
                    high = min(high, f.value - isinstance(f, D.LessThan))
                elif isinstance(f, D.EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, D.In) and f.value:
                    low, high = max(low, min(f.value)), min(high, max(f.value))
                self.within[column] = [low, high]
            yield f

    def wanted(self, block: tiff.Block) -> dict[int, int]:
        """Sample of the block by number of the band asked for."""
        low, high = self.within["band"]
        held = self.coding.shape[2]
        return {k: b - 1 - block.band for k, b in enumerate(self.bands, 1) if low <= k <= high and block.band < b <= block.band + held}

    def partitions(self) -> list[BlockPartition]:
        (r0, r1), (c0, c1) = self.within["row"], self.within["col"]
        _, every = tiff.layout(self.order, self.tags)
        found = [b for b in every if b.size and b.row <= r1 and b.row + b.rows > r0 and b.col <= c1 and b.col + b.cols > c0 and self.wanted(b)]
        self.tags = {}  # its lists of blocks need not travel with each task
        step = max(1, -(-len(found) // self.most))
        return [BlockPartition(found[k : k + step]) for k in range(0, len(found), step)]

    def read(self, partition: BlockPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        source = RangeFile(self.path)
        for block in partition.blocks:
            values = self.coding.decode(source(block.at, block.size), block)
            i, j = (x.ravel() for x in np.indices(values.shape[:2]))
            for band, sample in self.wanted(block).items():
                of = np.ascontiguousarray(values[..., sample]).ravel()
                missing = np.isnan(of) if self.nodata is None else np.isnan(of) | (of == self.nodata)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), band, np.int32)), pa.array(i + block.row), pa.array(j + block.col), pa.array(of, mask=missing)], ["band", "row", "col", "value"])


class GeoTiffBlocks(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff_blocks"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> BlockReader:
        bands = [int(b) for b in self.options.get("bands", "").split(",") if b.strip()]
        return BlockReader(self.options["path"], bands or None, int(self.options.get("partitions", MOST_PARTITIONS)))


def register(spark: SparkSession) -> None:
    """Makes the format known, and Spark offer filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffBlocks)


def scan(spark: SparkSession, path: str, bands: list[int] | None = None, crs: str | None = None) -> tuple[RasterMeta, DataFrame]:
    """The grid, and (band, row, col, value) by block: ``bands`` in the order asked for, missing values null."""
    register(spark)
    _, tags = tiff.directory(RangeFile(path))
    reader = spark.read.format("geotiff_blocks")
    if bands:
        reader = reader.option("bands", ",".join(map(str, bands)))
    return grid_of(tags, len(bands) if bands else tags.get(tiff.SAMPLES, (1,))[0], crs), reader.load(path)


#: Fixed value: how far the numbers of two bands' transforms may lie apart.
SAME_TRANSFORM = 1e-9


def scan_files(spark: SparkSession, paths: list[str], crs: str | None = None) -> tuple[RasterMeta, DataFrame]:
    """One grid of the first band of each file, numbered as the files are given; shapes and transforms must agree."""
    register(spark)
    grids = [grid_of(tiff.directory(RangeFile(p))[1], 1, crs) for p in paths]
    first = grids[0]
    for k, (path, g) in enumerate(zip(paths, grids), 1):
        if (g.rows, g.cols) != (first.rows, first.cols):
            raise TileError(f"{path}: band {k} has {g.rows} x {g.cols} cells, and band 1 {first.rows} x {first.cols}")
        apart = (g.origin_x - first.origin_x, g.origin_y - first.origin_y, g.px_w - first.px_w, g.px_h - first.px_h)
        if max(map(abs, apart)) > SAME_TRANSFORM:
            raise TileError(f"{path}: band {k} lies elsewhere than band 1")
    cells = None
    for k, path in enumerate(paths, 1):
        band = spark.read.format("geotiff_blocks").option("bands", "1").load(path).select(F.lit(k).alias("band"), "row", "col", "value")
        cells = band if cells is None else cells.unionByName(band)
    return replace(first, bands=len(paths)), cells


def describe(path: str, crs: str | None = None) -> dict:
    """What a file's directory says of its grid; no block is read."""
    _, tags = tiff.directory(RangeFile(path))
    grid = grid_of(tags, 1, crs)
    return {
        "path": path, "cols": grid.cols, "rows": grid.rows, "bands": tags.get(tiff.SAMPLES, (1,))[0], "crs": f"EPSG:{grid.crs}", "bounds": raster.bounds_degrees(grid),
        "cell": (grid.px_w, grid.px_h), "resolution": raster.native_resolution(grid), "native_zoom": raster.native_zoom(grid), "nodata": missing_value(tags),
    }
