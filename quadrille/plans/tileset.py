"""Tilesets: DataFrames (z, x, y, data) planned from cells or features."""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..codecs import image, mvt
from ..codecs.webp import webp
from ..functions import mercator as M
from ..operators import raster, vector
from .options import MvtOptions, PyramidOptions, RasterMeta

TILE = "z int, x long, y long, data binary"
#: Features that a task decodes at a time.
FEATURES = 5_000


def zooms(meta: RasterMeta, options: PyramidOptions) -> range:
    top = raster.native_zoom(meta, options.tile_size) if options.max_zoom is None else options.max_zoom
    return range(options.min_zoom, top + 1)


def count_tiles(meta: RasterMeta, options: PyramidOptions) -> int:
    """Tiles that the zooms enumerate, empty ones included."""
    return sum(enumerated(meta, options).values())


def pixels(cells: DataFrame, meta: RasterMeta, options: PyramidOptions) -> DataFrame:
    """(z, band, gx, gy, value) over all zooms; the sampling of each is chosen when planning, and zooms of
    area means come from one pass over the cells where they can."""
    wanted = zooms(meta, options)
    areas = [z for z in wanted if raster.uses_area(meta, z, options.tile_size)]
    every = raster.area_pyramid(cells, meta, areas, options.tile_size) if areas else None
    for z in wanted:
        if z not in areas:
            part = raster.sample_zoom(cells, meta, z, options.resampling, options.tile_size).withColumn("z", F.lit(z))
            every = part if every is None else every.unionByName(part)
    return every


def pixels_at_most(meta: RasterMeta, options: PyramidOptions) -> int:
    """Pixels of all zooms and bands: those near the grid, and no more than a cell each where areas are averaged."""
    total = 0
    for z in zooms(meta, options):
        w, s, e, n = raster.bounds_m(meta)
        res = 2 * M.ORIGIN_SHIFT_M / (options.tile_size * 2.0**z)
        near = (int((e - w) / res) + 2) * (int((n - s) / res) + 2)
        total += min(near, meta.rows * meta.cols) if raster.uses_area(meta, z, options.tile_size) else near
    return total * meta.bands


def raster_tileset(cells: DataFrame, meta: RasterMeta, options: PyramidOptions = PyramidOptions()) -> DataFrame:
    """PNG or WebP tiles. A tile without any pixel is never made; a transparent one with pixels is."""
    n, encode = options.tile_size, image.png if options.format == "png" else webp
    where = ["z", "gx", "gy"]
    sampled = pixels(cells, meta, options)
    size = pixels_at_most(meta, options)
    if meta.bands == 1:
        lo, hi = options.stretch or (lambda r: (r["lo"] or 0.0, r["hi"] or 0.0))(raster.auto_stretch(cells.where("band = 1")).first())
        shaded = sampled.select(*where, "value")
    else:
        lo, hi = options.stretch or (0.0, 255.0)
        one = raster.rgba(sampled, where, meta.bands, lo, hi, size)
        shaded = one.select(*where, F.expr("cast(r as double) + 256D * g + 65536D * b + 16777216D * a").alias("value"))
    placed = shaded.select("z", F.floor(F.col("gx") / n).alias("x"), F.floor(F.col("gy") / n).alias("y"), (F.col("gy") % n).cast("int").alias("i"), (F.col("gx") % n).cast("int").alias("j"), "value")
    single, scheme = meta.bands == 1, options.scheme

    def render(key, tile: pd.DataFrame) -> pd.DataFrame:
        if single:
            grid = np.full((n, n), np.nan)
            grid[tile["i"], tile["j"]] = tile["value"]
            rgba = image.coloured(grid, lo, hi, scheme)
        else:
            packed = tile["value"].to_numpy().astype(np.uint32)
            rgba = np.zeros((n, n, 4), np.uint8)
            rgba[tile["i"], tile["j"]] = packed.view(np.uint8).reshape(-1, 4)
        return pd.DataFrame({"z": [key[0]], "x": [key[1]], "y": [key[2]], "data": [encode(rgba)]})

    # a tile holds n * n pixels at most, so a group is bounded
    return raster.dealt(placed, size // meta.bands, "z", "x", "y").groupBy("z", "x", "y").applyInPandas(render, TILE)


def feature_tiles(features: DataFrame, options: MvtOptions = MvtOptions()) -> DataFrame:
    """Features in metres with each tile they show in: ``geom`` in tile coordinates."""
    cut = vector.clipped_tiles(features.select("layer", "layer_ord", "feature_ord", "kind", "id", "props", "parts"), options)
    return vector.tile_geometry(cut, options.extent).drop("parts")


#: Some features of one layer of one tile, encoded, with their tags as numbers into keys and values.
PARTIAL = "layer_ord int, layer string, orders array<long>, heads array<binary>, tag_counts array<int>, tags array<int>, bodies array<binary>, keys array<string>, values array<binary>"


def partial_layers(rows: DataFrame) -> DataFrame:
    """(z, x, y, PARTIAL): what a task's batch holds of a tile's layer becomes one row, before any shuffle.
    ``rows``: features in tile coordinates. A tile of a million points is encoded by as many tasks as hold them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, mvt.Partial] = defaultdict(mvt.Partial)
            geom = batch.column("geom")
            parts = geom.flatten()
            points = parts.flatten()
            xy = np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]) if len(points) else np.zeros((0, 2), np.int64)
            part_at, point_at = geom.offsets.to_numpy(), parts.offsets.to_numpy()
            part_at, point_at = part_at - part_at[0], point_at - point_at[0]
            columns = [batch.column(c).to_pylist() for c in ("z", "x", "y", "layer_ord", "layer", "feature_ord", "id", "kind", "props")]
            for k, (z, x, y, layer_ord, layer, order, ident, kind, props) in enumerate(zip(*columns)):
                shape = [xy[point_at[p] : point_at[p + 1]] for p in range(part_at[k], part_at[k + 1])]
                found[z, x, y, layer_ord, layer].add(order, None if ident is None else int(ident), kind, shape, props)
            if found:
                yield partial_batch(found)

    return rows.select("z", "x", "y", "layer_ord", "layer", "feature_ord", F.col("id").cast("string").alias("id"), "kind", "geom", "props").mapInArrow(encode, "z int, x long, y long, " + PARTIAL)


def partial_batch(found: dict[tuple, mvt.Partial]) -> pa.RecordBatch:
    whole = pa.list_(pa.int32())
    each = [(*place, [f[0] for f in p.features], [f[1] for f in p.features], [len(f[2]) for f in p.features], [t for f in p.features for t in f[2]], [f[3] for f in p.features], list(p.keys), list(p.values)) for place, p in found.items()]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary()), whole, whole, pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.binary()))
    names = ["z", "x", "y", *(c.split()[0] for c in PARTIAL.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*each), types)], names)


def merged_tiles(partials: DataFrame, options: MvtOptions = MvtOptions()) -> DataFrame:
    """MVT tiles of partial layers. A group holds a tile's encoded features, which are the tile itself, as columns of bytes."""
    import gzip

    extent, compress = options.extent, options.compress

    def merge(key: tuple[pa.Scalar, ...], partials_: pa.Table) -> pa.Table:
        rows: dict[tuple, list[int]] = defaultdict(list)
        for k, place in enumerate(zip(partials_.column("layer_ord").to_pylist(), partials_.column("layer").to_pylist())):
            rows[place].append(k)
        layers = []
        for place in sorted(rows):
            own = partials_.take(pa.array(rows[place])) if len(rows) > 1 else partials_
            layers.append(mvt.merged_layer(place[1], own, extent))
        data = b"".join(x for layer in layers for x in (mvt.varint(3 << 3 | 2) + mvt.varint(len(layer)), layer))
        del layers
        return pa.table({"z": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([key[1].as_py()], pa.int64()), "y": pa.array([key[2].as_py()], pa.int64()), "data": pa.array([gzip.compress(data, mtime=0) if compress else data], pa.binary())})

    return partials.groupBy("z", "x", "y").applyInArrow(merge, TILE)


def vector_tileset(features: DataFrame, options: MvtOptions = MvtOptions()) -> DataFrame:
    """MVT tiles, gzipped if the options say so: geometry is cut and encoded before the shuffle, partial layers are merged after it."""
    return merged_tiles(partial_layers(feature_tiles(features, options)), options)


def decoded(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, nth, id, kind, geom, props) of every feature of MVT tiles, gzipped or not; properties as text."""
    import gzip

    point = pa.struct([("x", pa.int64()), ("y", pa.int64())])
    types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.decimal128(20), pa.string(), pa.list_(pa.list_(point)), pa.map_(pa.string(), pa.string()))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for z, x, y, data in zip(*(batch.column(c) for c in ("z", "x", "y", "data"))):
                place, data = (z.as_py(), x.as_py(), y.as_py()), data.as_py()
                for layer, features in mvt.read_layers(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    for nth, f in enumerate(features):
                        props = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in f["props"].items()]
                        yield *place, layer["name"], nth, f["id"], f["kind"], [[{"x": a, "y": b} for a, b in part] for part in f["geom"]], props

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = every(batches)
        while rows := list(islice(found, FEATURES)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["z", "x", "y", "layer", "nth", "id", "kind", "geom", "props"])

    return tiles.select("z", "x", "y", "data").mapInArrow(read, "z int, x long, y long, layer string, nth int, id decimal(20,0), kind string, geom array<array<struct<x:long,y:long>>>, props map<string,string>")


def vector_layers_json(features: DataFrame, options: MvtOptions) -> str:
    """The layer catalogue of a vector tileset: per key the type of its first value that is not null."""
    label = F.when(F.col("p.t") == "Bool", "Boolean").when(F.col("p.t").isin("Int", "Float"), "Number").when(F.col("p.t") == "String", "String")
    props = features.select("layer", "layer_ord", F.col("feature_ord").alias("ord"), F.explode_outer("props").alias("p")).select("layer", "layer_ord", "ord", F.col("p.k").alias("k"), label.alias("t"))
    rows = vector.layer_fields(props).collect()  # a row per layer and key
    order = [r["layer"] for r in features.groupBy("layer").agg(F.min("layer_ord").alias("o")).orderBy("o").collect()]
    fields = {name: {r["key"]: r["type"] for r in sorted(rows, key=lambda r: r["key"]) if r["layer"] == name} for name in order}
    return json.dumps({"vector_layers": [{"id": name, "minzoom": options.min_zoom, "maxzoom": options.max_zoom, "fields": f} for name, f in fields.items()]})


def metadata_rows(name: str, fmt: str, bounds: tuple[float, float, float, float], min_zoom: int, max_zoom: int, json_text: str | None = None) -> list[tuple[str, str]]:
    """Name and value of a tileset's metadata, in order."""
    def number(v: float) -> str:
        return f"{v:.17f}".rstrip("0").rstrip(".") if "e" in repr(v) else repr(v).removesuffix(".0")

    w, s, e, n = bounds
    rows = [("name", name), ("format", fmt), ("bounds", ",".join(map(number, bounds))), ("center", f"{number((w + e) / 2)},{number((s + n) / 2)},{min_zoom}"), ("minzoom", str(min_zoom)), ("maxzoom", str(max_zoom)), ("type", "overlay"), ("version", "1"), ("description", name)]
    return rows + ([("json", json_text)] if json_text else [])


def enumerated(meta: RasterMeta, options: PyramidOptions) -> dict[int, int]:
    """Tiles of each zoom, empty ones included."""
    extents = {z: raster.tile_extent(meta, z) for z in zooms(meta, options)}
    return {z: (x1 - x0 + 1) * (y1 - y0 + 1) for z, (x0, x1, y0, y1) in extents.items()}


def stats(tiles: DataFrame, meta: RasterMeta, options: PyramidOptions) -> DataFrame:
    """(z, written, skipped) for each zoom; tiles enumerated but without a pixel are skipped."""
    made = tiles.groupBy("z").agg(F.count(F.lit(1)).alias("written"))
    total = tiles.sparkSession.createDataFrame(list(enumerated(meta, options).items()), "z int, n long")
    return total.join(made, "z", "left").select("z", F.coalesce("written", F.lit(0)).alias("written"), (F.col("n") - F.coalesce("written", F.lit(0))).alias("skipped"))


def observed(tiles: DataFrame, wanted: range, name: str = "tiles") -> tuple[DataFrame, Observation]:
    """``tiles``, and what the action that writes them will have counted: tiles and bytes of each zoom.
    Nothing is computed again for it; tasks that are repeated count once."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")
    counts = [F.count_if(F.col("z") == z).alias(f"tiles_{z}") for z in wanted] + [F.sum(F.when(F.col("z") == z, size).otherwise(0)).alias(f"bytes_{z}") for z in wanted]
    return tiles.observe(seen, *counts), seen


def progress(seen: Observation, meta: RasterMeta | None = None, options: PyramidOptions | None = None) -> list[dict]:
    """A row of each zoom: written and bytes, and skipped if the grid is given. Waits for the action."""
    got = seen.get
    total = enumerated(meta, options) if meta else {}
    out = []
    for z in sorted(int(k.removeprefix("tiles_")) for k in got if k.startswith("tiles_")):
        out.append({"z": z, "written": got[f"tiles_{z}"], "bytes": got[f"bytes_{z}"] or 0} | ({"skipped": total[z] - got[f"tiles_{z}"]} if total else {}))
    return out


def feature_totals(features: DataFrame) -> tuple[DataFrame, Observation]:
    """``features``, and their number and that of their layers, counted by the action that reads them."""
    seen = Observation(f"features-{uuid.uuid4().hex}")
    return features.observe(seen, F.count(F.lit(1)).alias("features"), F.size(F.collect_set("layer")).alias("layers")), seen


def sizes_report(tiles: DataFrame, limit: int = 500_000, accuracy: int = 10_000) -> DataFrame:
    """(z, tiles, oversize, median, p99, largest): encoded bytes of each zoom's tiles, and how many are above
    ``limit``. Quantiles are sketches that tasks merge, off by at most 1 / accuracy of the tiles in rank."""
    size = F.octet_length("data").cast("long")
    return tiles.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(size > limit).alias("oversize"), F.percentile_approx(size, 0.5, accuracy).alias("median"), F.percentile_approx(size, 0.99, accuracy).alias("p99"), F.max(size).alias("largest"))


def heaviest(tiles: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` tiles of most bytes: (z, x, y, bytes)."""
    return tiles.select("z", "x", "y", F.octet_length("data").cast("long").alias("bytes")).orderBy(F.desc("bytes"), "z", "x", "y").limit(n)
