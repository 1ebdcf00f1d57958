"""Vector tiles (version 2.1 of the public specification) and tiles as JSON."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.features import count_abbreviation, scalar_tags
from shoal.functions.geometry import WORLD, EngineError, Options
from shoal.plans import reads

LAYER = "points"
FORMATS = {"mvt": "mvt", "pbf": "mvt", "json": "json", "geojson": "json"}


def tile_format(name: str) -> tuple[str, str]:
    """("y", format) of a tile's last path part; mvt if it has no extension."""
    y, _, ext = name.partition(".")
    if ext and ext not in FORMATS:
        raise EngineError("bad_request", f"unknown tile format {ext}")
    return y, FORMATS.get(ext, "mvt")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def encode_layer(features: list[tuple[int, int, int | None, list[tuple[str, object]]]], extent: float, name: str = LAYER) -> bytes:
    """A tile with one layer of points (x, y, id, tags); no bytes if there is no point."""
    if not features:
        return b""
    keys: dict[str, int] = {}
    values: dict[tuple[str, object], int] = {}
    body = b""
    for x, y, ident, tags in features:
        packed = b""
        for key, value in tags:
            packed += _varint(keys.setdefault(key, len(keys)))
            packed += _varint(values.setdefault((type(value).__name__, value), len(values)))
        geometry = _varint(1 << 3 | 1) + _varint(_zigzag(x)) + _varint(_zigzag(y))
        one = (_field(1, ident) if ident is not None else b"") + _field(2, packed) + _field(3, 1) + _field(4, geometry)
        body += _field(2, one)
    layer = _field(15, 2) + _field(1, name.encode()) + body
    for key in keys:
        layer += _field(3, key.encode())
    for kind, value in values:
        number = {"str": 1, "int": 5, "bool": 7}[kind]
        layer += _field(4, _field(number, value.encode() if kind == "str" else int(value)))
    return _field(3, layer + _field(5, int(extent)))


def tile_mvt(tiles: DataFrame, opts: Options, devices: DataFrame | None = None) -> DataFrame:
    """(collection, tx, ty, tile): each tile of tile_features encoded. A tile holds a bounded number of markers, since these are
    a scale apart."""
    out = tiles.withColumn("device", F.col("one").cast("string"))
    if devices is not None:
        d = devices.select("collection", F.col("num").alias("one"), F.col("id").alias("device"), "props")
        out = tiles.join(d, ["collection", "one"], "left")
        tags = scalar_tags(d.where("props IS NOT NULL")).groupBy("collection", "one").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "value"))).alias("tags"))
        out = out.join(tags, ["collection", "one"], "left")
    else:
        out = out.withColumn("tags", F.lit(None).cast("array<struct<key:string,kind:string,value:string>>"))
    extent = opts.extent

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        features = []
        for r in pdf.sort_values("rep").itertuples(index=False):
            n = int(r.cnt)
            if n > 1:
                tags = [("cluster", True), ("point_count", n), ("point_count_abbreviated", r.label)]
                features.append((int(r.x), int(r.y), int(r.rep) * 32 + int(r.zoom), tags))
            else:
                read = {"bool": lambda v: v == "true", "uint": int, "string": str}
                own = [(t["key"], read[t["kind"]](t["value"])) for t in (r.tags if r.tags is not None else [])]
                features.append((int(r.x), int(r.y), None, [("cluster", False), ("id", r.device or ""), *own]))
        return pd.DataFrame({"collection": [pdf.collection.iloc[0]], "tx": [pdf.tx.iloc[0]], "ty": [pdf.ty.iloc[0]], "tile": [encode_layer(features, extent)]})

    cols = ["collection", "tx", "ty", "rep", "x", "y", "cnt", "zoom", "device", "tags", count_abbreviation(F.col("cnt")).alias("label")]
    return out.select(*cols).groupBy("collection", "tx", "ty").applyInPandas(run, "collection string, tx bigint, ty bigint, tile binary")


def tile(segs: DataFrame, opts: Options, z: int, x: int, y: int, devices: DataFrame | None = None, cat: int | None = None, kind: str = "mvt") -> bytes | list[str]:
    """One tile: its bytes (none if it is empty), or its features as JSON texts. Only points about the tile are read."""
    if not 0 <= z <= 20 or not (0 <= x < 1 << z and 0 <= y < 1 << z):
        raise EngineError("bad_request", f"there is no tile {z}/{x}/{y}")
    side, pad = WORLD / (1 << z), WORLD / (1 << z) * opts.radius / opts.extent
    lng = [unproject(v, True) for v in (x * side - pad, (x + 1) * side + pad)]
    lat = [unproject(v, False) for v in ((y + 1) * side + pad, y * side - pad)]
    found = reads.tile_features(segs, opts, z, cat, (lng[0], lat[0], lng[1], lat[1])).where((F.col("tx") == x) & (F.col("ty") == y))
    if kind == "json":
        return [r["feature"] for r in tile_json(found, opts).orderBy("rep").select("feature").collect()]
    got = tile_mvt(found, opts, devices).head(1)
    return bytes(got[0]["tile"]) if got else b""


def unproject(v: float, along_x: bool) -> float:
    """Degrees of a place on the world's square, kept a little inside it."""
    u = min(max(v / WORLD, 1e-9), 1 - 1e-9)
    return u * 360 - 180 if along_x else math.degrees(2 * math.atan(math.exp((0.5 - u) * 2 * math.pi))) - 90


def tile_json(tiles: DataFrame, opts: Options) -> DataFrame:
    """(collection, tx, ty, rep, feature): features in tile units, with the extent and a note that says so."""
    feature = F.format_string('{"cluster":%s,"id":%d,"count":%d,"x":%d,"y":%d}', F.when(F.col("cnt") > 1, "true").otherwise("false"), F.col("rep"), F.col("cnt"), F.col("x"), F.col("y"))
    return tiles.select("collection", "tx", "ty", "rep", feature.alias("feature"), F.lit(int(opts.extent)).alias("extent"), F.lit("coordinates are tile units").alias("note"))
