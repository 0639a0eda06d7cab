"""Sources: GeoTIFF to cells, GeoJSON, GeoPackage and GeoParquet to features, MBTiles to tiles.

Files are read by Spark's readers as bytes or text and decoded in tasks, so any file system that
Spark knows will do.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import tiff
from ..operators import raster, vector
from ..plans.options import RasterMeta, TileError
from . import shapefile, sqlite


def layer_spec(text: str) -> tuple[str, str, str | None]:
    """(name, path, table) of ``[name=]path[#table]``; the name is the file's stem if not given."""
    name, eq, rest = text.partition("=")
    path, _, table = (rest if eq else text).partition("#")
    if not path:
        raise TileError(f"no path in {text!r}")
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2])
    return (name if eq and name else stem or "layer"), path, table or None


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None, crs: str | None = None) -> tuple[RasterMeta, DataFrame]:
    """The grid, and (band, row, col, value): ``bands`` in the order asked for, missing values null."""
    file = spark.read.format("binaryFile").load(path).select("content")
    part = lambda at, n: bytes(file.select(F.substring("content", at + 1, n)).first()[0])
    head = part(0, 1 << 20)
    _, tags = tiff.directory(lambda at, n: head[at : at + n] if at + n <= len(head) else part(at, n))
    count = tags.get(tiff.SAMPLES, (1,))[0]
    wanted = bands or list(range(1, count + 1))
    if any(not 1 <= b <= count for b in wanted):
        raise TileError(f"bands {wanted} of {count}")
    ox, oy, pw, ph = tiff.geo(tags)
    h, w = tags[tiff.HEIGHT][0], tags[tiff.WIDTH][0]
    nodata = float(tags[tiff.NODATA][0].strip()) if tags.get(tiff.NODATA, ("",))[0].strip() else None
    found = raster.detect_crs((ox, oy - h * ph, ox + w * pw, oy), tiff.epsg(tags), crs)
    meta = RasterMeta(h, w, ox, oy, pw, ph, found, len(wanted))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for r, c, first, block in tiff.blocks(content.as_py()):
                    i, j = np.indices(block.shape[:2])
                    for k, b in enumerate(wanted, 1):
                        if first < b <= first + block.shape[2]:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(i.size, k, np.int32)), pa.array((i + r).ravel()), pa.array((j + c).ravel()), pa.array(block[..., b - 1 - first].ravel())], ["band", "row", "col", "value"])

    return meta, raster.normalised(file.mapInArrow(cells, "band int, row long, col long, value double"), None if nodata is None or nodata != nodata else nodata)


#: How a geometry's coordinates nest, by kind.
_COORDINATES = {
    "Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>",
    "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>",
}


def _parts(kind, coordinates):
    """Parts from the JSON text of coordinates."""
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    ring = lambda r: F.transform(r, point)
    rings = lambda rs: F.transform(rs, ring)
    build = {
        "Point": lambda c: F.array(F.array(F.array(point(c)))), "MultiPoint": lambda c: F.array(F.array(ring(c))), "LineString": lambda c: F.array(F.array(ring(c))),
        "MultiLineString": lambda c: F.transform(c, lambda line: F.array(ring(line))), "Polygon": lambda c: F.array(rings(c)), "MultiPolygon": lambda c: F.transform(c, rings),
    }
    out = F.lit(None).cast(vector.PARTS)
    for name, schema in _COORDINATES.items():
        out = F.when(kind == name, build[name](F.from_json(coordinates, schema))).otherwise(out)
    return out


def typed(key, value):
    """A property from its JSON text: Bool, Int if it fits 64 bits, Float, String (also for arrays and objects), Null."""
    text = F.when(value.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))).otherwise(value)
    whole = F.when(F.rlike(value, F.lit(r"^-?[0-9]{1,38}$")), value.cast("decimal(38,0)"))
    small = whole.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    kind = (
        F.when(value.isNull() | (value == "null"), "Null").when(value.isin("true", "false"), "Bool").when(F.rlike(value, F.lit(r"^-?[0-9]")) & F.coalesce(small, F.lit(False)), "Int")
        .when(F.rlike(value, F.lit(r"^-?[0-9]")), "Float").otherwise("String"))
    return F.struct(key.alias("k"), kind.alias("t"), F.when(kind == "Bool", value == "true").alias("b"), F.when(kind == "Int", whole.cast("bigint")).alias("i"), F.when(kind == "Float", value.try_cast("double")).alias("d"), F.when(kind == "String", text).alias("s"))


FEATURE = "struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"


def features_of(records: DataFrame, layer: str, layer_ord: int = 0) -> DataFrame:
    """Features from (feature_ord, text), the text of a Feature or of a bare geometry; those without a geometry go."""
    doc = records.select("feature_ord", F.from_json("text", "struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,coordinates:string>").alias("f"), F.from_json("text", "struct<properties:string>").getField("properties").alias("json"))
    geometry = F.coalesce(F.col("f.geometry"), F.struct(F.col("f.type").alias("type"), F.col("f.coordinates").alias("coordinates")))
    rows = doc.select("feature_ord", F.col("f.id").alias("id"), geometry.alias("geometry"), "json")
    keys = F.array_sort(F.json_object_keys("json"))
    # values as JSON text, to tell "1" from 1
    quoted = F.from_json(F.col("json"), "map<string,variant>")
    props = F.when(F.col("json").startswith("{"), F.transform(keys, lambda k: typed(k, F.to_json(F.element_at(quoted, k)))))
    parts = _parts(F.col("geometry.type"), F.col("geometry.coordinates"))
    found = rows.select(F.lit(layer).alias("layer"), F.lit(layer_ord).alias("layer_ord"), F.col("feature_ord").cast("long").alias("feature_ord"), F.col("geometry.type").alias("kind"), parts.alias("parts"), vector.feature_id(F.col("id")).alias("id"), props.alias("props"))
    return found.where("parts is not null")


def read_geojson(spark: SparkSession, path: str, layer: str, layer_ord: int = 0) -> DataFrame:
    """Features of a FeatureCollection, a Feature or a bare geometry, in order, from any store that Spark knows.
    The file is one row here; ``geojson.scan`` reads it by range."""
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", "struct<type:string,features:array<string>>")
    texts = text.select(F.posexplode(F.when(whole.getField("type") == "FeatureCollection", whole.getField("features")).otherwise(F.array("value"))).alias("feature_ord", "text"))
    return features_of(texts, layer, layer_ord)


def wkb(data: bytes) -> tuple[str, list] | None:
    """(kind, parts) of a two-dimensional or higher WKB geometry; further dimensions are left out."""
    at = 0

    def geometry():
        nonlocal at
        order = "<" if data[at] else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if code & 0x20000000:
            at += 4
        more, kind = divmod(code & 0xFFFF, 1000)
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[more]

        def count():
            nonlocal at
            at += 4
            return struct.unpack_from(order + "I", data, at - 4)[0]

        def points(n):
            nonlocal at
            v = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)
            at += n * dims * 8
            return [{"x": float(a), "y": float(b)} for a, b in v[:, :2]]

        if kind == 1:
            return "Point", [[points(1)]]
        if kind == 2:
            return "LineString", [[points(count())]]
        if kind == 3:
            return "Polygon", [[points(count()) for _ in range(count())]]
        subs = [geometry() for _ in range(count())]
        if kind == 4:
            return "MultiPoint", [[[p for _, s in subs for p in s[0][0]]]]
        return ({5: "MultiLineString", 6: "MultiPolygon"}.get(kind, "GeometryCollection"), [poly for _, s in subs for poly in s])

    return geometry()


def read_geoparquet(spark: SparkSession, path: str, layer: str, layer_ord: int = 0, geometry: str = "geometry") -> DataFrame:
    """Features of a table with a WKB column; other columns are properties. Files are numbered in order of path and row."""
    table = spark.read.parquet(path)
    others = [(c, t) for c, t in table.dtypes if c != geometry]

    def prop(c: str, t: str):
        v = F.col(c)
        whole, real = t in ("tinyint", "smallint", "int", "bigint"), t in ("float", "double") or t.startswith("decimal")
        kind = "Bool" if t == "boolean" else "Int" if whole else "Float" if real else "String"
        of = lambda k, x, cast: (x if kind == k else F.lit(None)).cast(cast)
        return F.struct(F.lit(c).alias("k"), F.when(v.isNull(), "Null").otherwise(kind).alias("t"), of("Bool", v, "boolean").alias("b"), of("Int", v, "bigint").alias("i"), of("Float", v, "double").alias("d"), of("String", v.cast("string") if t in ("string", "date") or t.startswith("timestamp") else F.to_json(F.struct(v)), "string").alias("s"))

    rows = table.select(F.monotonically_increasing_id().alias("feature_ord"), F.col(geometry).alias("wkb"), F.array(*[prop(c, t) for c, t in sorted(others)]).cast(vector.PROP).alias("props"))

    def decode(batches):
        for batch in batches:
            got = [wkb(x) if x else None for x in batch.column("wkb").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("feature_ord"), pa.array([g and g[0] for g in got], pa.string()), pa.array([g and g[1] for g in got], pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))), batch.column("props")], ["feature_ord", "kind", "parts", "props"])

    found = rows.mapInArrow(decode, f"feature_ord long, kind string, parts {vector.PARTS}, props {vector.PROP}")
    return found.where("kind is not null").select(F.lit(layer).alias("layer"), F.lit(layer_ord).alias("layer_ord"), "feature_ord", "kind", "parts", F.lit(None).cast("decimal(20,0)").alias("id"), "props")


def read_geopackage(spark: SparkSession, path: str, layer: str, layer_ord: int = 0, table: str | None = None, rows: int = sqlite.ROWS) -> DataFrame:
    """Features of one table of a GeoPackage, the first if none is named, in order of row id."""
    listed = sqlite.asked(spark, path, lambda db: db.execute("select table_name, column_name from gpkg_geometry_columns order by rowid").fetchall(), "name string, geom string")
    name, column = next(((t, c) for t, c in listed if table in (None, t)), (None, None))
    if name is None:
        raise TileError(f"no table {table or 'of features'} in {path}")
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    prop = pa.struct([("k", pa.string()), ("t", pa.string()), ("b", pa.bool_()), ("i", pa.int64()), ("d", pa.float64()), ("s", pa.string())])
    types = (pa.int64(), pa.string(), pa.list_(pa.list_(pa.list_(point))), pa.string(), pa.list_(prop))

    def features(db, low: int, high: int) -> Iterator[pa.RecordBatch]:
        cursor = db.execute(f"select rowid, * from {sqlite.quoted(name)} where rowid between ? and ? order by rowid", (low, high))
        names = [d[0] for d in cursor.description[1:]]
        keys = [r[1] for r in db.execute(f"pragma table_info({sqlite.quoted(name)})") if r[5]]
        while part := cursor.fetchmany(2000):
            out = []
            for row_id, *row in part:
                values = dict(zip(names, row))
                blob = values.pop(column)
                ident = values.pop(keys[0]) if keys else None
                if not blob:
                    continue
                head = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
                kind, parts = wkb(blob[head:])
                props = []
                for k in sorted(values):
                    v = values[k]
                    t = "Null" if v is None else "Int" if isinstance(v, int) else "Float" if isinstance(v, float) else "String"
                    props.append({"k": k, "t": t, "b": None, "i": v if t == "Int" else None, "d": v if t == "Float" else None, "s": str(v) if t == "String" else None})
                out.append((row_id, kind, parts, None if ident is None else str(ident), props))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["feature_ord", "kind", "parts", "ident", "props"])

    found = sqlite.table_rows(spark, path, name, features, f"feature_ord long, kind string, parts {vector.PARTS}, ident string, props {vector.PROP}", rows)
    return found.select(F.lit(layer).alias("layer"), F.lit(layer_ord).alias("layer_ord"), "feature_ord", "kind", "parts", vector.feature_id(F.col("ident")).alias("id"), "props")


def read_layers(spark: SparkSession, specs: list[str], crs: str | None = None) -> DataFrame:
    """All layers in metres; names must differ, and the first layer must hold a feature."""
    parsed = [layer_spec(s) for s in specs]
    if len({n for n, _, _ in parsed}) < len(parsed):
        raise TileError("layer names must differ")
    every = None
    for k, (name, path, table) in enumerate(parsed):
        kind = path.rpartition(".")[2].lower()
        if kind in ("geojson", "json"):
            layer = read_geojson(spark, path, name, k)
        elif kind == "gpkg":
            layer = read_geopackage(spark, path, name, k, table)
        elif kind in ("parquet", "geoparquet"):
            layer = read_geoparquet(spark, path, name, k)
        elif kind == "shp":
            layer = shapefile.scan(spark, path, name, k)
        else:
            raise TileError(f"unknown kind of file: {path}")
        layer = vector.with_bbox(vector.to_metres(layer, crs)).drop("min_x", "min_y", "max_x", "max_y")
        if not k and not layer.limit(1).count():
            raise TileError("the first layer has no features")
        every = layer if every is None else every.unionByName(layer)
    return every


def read_mbtiles(spark: SparkSession, path: str, rows: int = sqlite.ROWS) -> tuple[dict[str, str], DataFrame]:
    """Metadata by name, and the tileset (z, x, y, data) in XYZ rows."""

    def tiles(db, low: int, high: int) -> Iterator[pa.RecordBatch]:
        cursor = db.execute("select zoom_level, tile_column, (1 << zoom_level) - 1 - tile_row, tile_data from tiles where rowid between ? and ?", (low, high))
        while part := cursor.fetchmany(1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["z", "x", "y", "data"])

    about = sqlite.asked(spark, path, lambda db: db.execute("select name, value from metadata").fetchall(), "name string, value string")
    named = {"format": "png", "minzoom": "0", "maxzoom": "14", "bounds": "-180,-85,180,85"} | dict(about)
    return named, sqlite.table_rows(spark, path, "tiles", tiles, "z int, x long, y long, data binary", rows)


def vector_layers(named: dict[str, str]) -> list[dict] | None:
    """The layers that a tileset's metadata lists, None where it lists none or not as it should."""
    try:
        found = json.loads(named["json"])["vector_layers"]
    except (KeyError, TypeError, ValueError):
        return None
    return found if isinstance(found, list) else None


def lookup(tiles: DataFrame, z: int, x: int, y: int) -> DataFrame:
    return tiles.where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y))


def answer(fmt: str, found: bool, valid: bool = True, known: bool = True) -> tuple[int, str | None, str | None]:
    """(status, content type, content encoding) of a tile request."""
    from ..sinks.tile_index import OTHER_TYPE, TYPES

    if not valid:
        return 400, None, None
    if not known:
        return 404, None, None
    if not found:
        return 204, None, None
    return 200, TYPES.get(fmt, OTHER_TYPE), "gzip" if fmt == "pbf" else None
