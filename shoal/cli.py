"""A thin command line over snapshots and report files: python -m shoal.cli COMMAND … [--json]. Exit codes: 0, 1 refused, 2 misuse."""

from __future__ import annotations

import argparse
import base64
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.features import feature_collection
from shoal.functions.geometry import EngineError, Options, parse_box, parse_zoom
from shoal.operators import net
from shoal.plans import catalog, reads, tiles, verify
from shoal.sources import reports as ingest
from shoal.sources import fleet, snapshot

LIMIT = 20


def _show(df: DataFrame, as_json: bool, limit: int = LIMIT) -> None:
    if as_json:
        for line in df.limit(limit).toJSON().toLocalIterator():
            print(line)
    else:
        df.show(limit, truncate=False)


def _index(spark: SparkSession, path: str, name: str, opts: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    devices = snapshot.read(spark, path).where(F.col("collection") == name)
    nodes = net.build_nodes(devices, opts)
    return devices, nodes, net.segments(nodes, opts)


def _taken(spark: SparkSession, a: argparse.Namespace, bodies: DataFrame) -> DataFrame:
    """Bodies go into a collection, which is made unless that is forbidden; sound ones all, others not at all."""
    stored = catalog.Catalog.stored(spark, a.path, not a.no_create)
    if a.collection not in stored.collections and stored.auto_create:
        stored.create(a.collection, _options(a))
    opts = stored.get(a.collection)
    sized = ingest.within_limit(bodies, a.max_body)
    parsed = ingest.parse(sized.where("problem IS NULL").drop("problem"))
    changes = stored.ingest(a.collection, ingest.accepted(parsed, opts), F.lit(a.at).cast("timestamp") if a.at else None)
    errors = ingest.problems(parsed, opts).where("problem IS NOT NULL").select("batch", "problem").union(sized.where("problem IS NOT NULL").select("batch", "problem"))
    for batch, problem in errors.orderBy("batch").limit(LIMIT).collect():
        print(f"body {batch}: {problem}", file=sys.stderr)
    refused = errors.select("batch").distinct().count()
    return changes.agg(F.count(F.lit(1)).alias("devices")).withColumn("refused", F.lit(refused))


def _options(a: argparse.Namespace) -> Options:
    return Options(categories=tuple(a.categories.split(",")) if a.categories else (), ttl_seconds=a.ttl, max_zoom=a.max_zoom, radius=a.radius)


def _report(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    body = {"id": a.id, "lng": a.lng, "lat": a.lat} | ({"cat": a.cat} if a.cat else {}) | ({"props": json.loads(a.props)} if a.props else {})
    return _taken(spark, a, spark.createDataFrame([(0, json.dumps(body))], "batch bigint, value string"))


def _seed(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A synthetic fleet of --limit devices."""
    stored = catalog.Catalog.stored(spark, a.path, not a.no_create)
    if a.collection not in stored.collections and stored.auto_create:
        stored.create(a.collection, _options(a))
    stored.get(a.collection)
    made = fleet.fleet(spark, a.limit, a.collection).select(F.col("num").alias("batch"), F.lit(0).alias("at"), F.concat(F.lit("dev-"), F.col("num").cast("string")).alias("id"), "qx", "qy", "cat", F.lit(None).cast("string").alias("props"))
    return stored.ingest(a.collection, made).agg(F.count(F.lit(1)).alias("devices"))


def _stats(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    d = snapshot.read(spark, a.path)
    plain = d.groupBy("collection").agg(F.count(F.lit(1)).alias("devices"), F.coalesce(F.sum(F.octet_length("props")), F.lit(0)).alias("props_bytes"), F.max("last_seen").alias("last_report"))
    names = spark.createDataFrame([(n,) for n in snapshot.listed(spark, a.path)], "collection string")
    plain = names.join(plain, "collection", "left").fillna(0, ["devices", "props_bytes"])
    return catalog.full_stats(plain, snapshot.info(spark, a.path).drop("devices")).orderBy("collection")


def _tile(spark: SparkSession, a: argparse.Namespace, opts: Options, devices: DataFrame, segs: DataFrame) -> DataFrame:
    try:
        z, x, last = a.tile.split("/")
        y, kind = tiles.tile_format(last)
        place = int(z), int(x), int(y)
    except ValueError:
        raise EngineError("bad_request", "a tile is z/x/y, z/x/y.mvt or z/x/y.json") from None
    got = tiles.tile(segs, opts, *place, devices, ingest.category_of(a.cat, opts), kind)
    if kind == "json":
        return spark.createDataFrame([(json.dumps([json.loads(x) for x in got]),)], "features string")
    return spark.createDataFrame([(a.tile, len(got), base64.b64encode(got).decode())], "tile string, bytes int, base64 string")


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command == "collections":
        return _stats(spark, a).select("collection", "devices")
    if a.command in ("health", "watch"):
        return catalog.health(_stats(spark, a))
    if a.command == "stats":
        return _stats(spark, a)
    if a.command == "import":
        return _taken(spark, a, ingest.read_bodies(spark, a.file))
    if a.command == "report":
        return _report(spark, a)
    if a.command == "seed":
        return _seed(spark, a)
    stored = catalog.Catalog.stored(spark, a.path)
    if a.command == "create":
        return spark.createDataFrame([(a.collection, stored.create(a.collection, _options(a)))], "collection string, created boolean")
    opts = stored.get(a.collection)
    if a.command == "drop":
        stored.drop(a.collection)
        return spark.createDataFrame([(a.collection,)], "dropped string")
    if a.command == "rm":
        stored.remove(a.collection, a.id)
        return spark.createDataFrame([(a.id,)], "removed string")
    if a.command == "snapshot":
        snapshot.write(snapshot.read(spark, a.path).where(F.col("collection") == a.collection), a.to, {a.collection: opts})
        return snapshot.info(spark, a.to).where(F.col("collection") == a.collection)
    devices, nodes, segs = _index(spark, a.path, a.collection, opts)
    if a.command == "get":
        found = devices.where(F.col("id") == a.id)
        if not found.head(1):
            raise EngineError("device_not_registered", f"{a.id} is not registered")
        return found
    if a.command == "has":
        return spark.createDataFrame([(a.id, bool(devices.where(F.col("id") == a.id).head(1)))], "id string, live boolean")
    zoom = parse_zoom(a.zoom)
    if a.command == "clusters":
        return reads.features(reads.clusters(segs, opts, zoom, ingest.category_of(a.cat, opts), parse_box(a.bbox)), devices)
    if a.command == "geojson":
        return feature_collection(reads.features(reads.clusters(segs, opts, zoom, ingest.category_of(a.cat, opts), parse_box(a.bbox)), devices))
    if a.command == "tile":
        return _tile(spark, a, opts, devices, segs)
    if a.command == "where":
        num = devices.where(F.col("id") == a.id).head(1)
        if not num:
            raise EngineError("device_not_registered", f"{a.id} is not registered")
        return reads.features(reads.cluster_of(segs, opts, F.lit(num[0].num), zoom, a.collection), devices)
    if a.command == "children":
        return reads.features(reads.children(segs, nodes, opts, a.cluster, a.collection), devices)
    if a.command == "leaves":
        return reads.leaves(segs, nodes, a.cluster, a.collection, a.limit, a.offset).join(devices.select("num", "id"), "num")
    return verify.verify(nodes, segs, opts)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shoal")
    p.add_argument("command", choices="collections health stats watch create import report seed rm drop snapshot get has clusters geojson tile where children leaves verify".split())
    p.add_argument("--path", required=True, help="folder of the snapshot")
    p.add_argument("--collection", default="default")
    p.add_argument("--file", help="import: reports as NDJSON, an array, or an object with points")
    p.add_argument("--to", help="snapshot: the folder to write to")
    p.add_argument("--no-create", action="store_true", help="refuse reports to collections that do not exist")
    p.add_argument("--max-body", type=int, default=ingest.MAX_BODY)
    p.add_argument("--at", help="time of the reports, now if left out")
    p.add_argument("--categories", default="")
    p.add_argument("--ttl", type=int, default=Options.ttl_seconds)
    p.add_argument("--max-zoom", type=int, default=Options.max_zoom)
    p.add_argument("--radius", type=float, default=Options.radius)
    p.add_argument("--id", default="")
    p.add_argument("--lng", type=float)
    p.add_argument("--lat", type=float)
    p.add_argument("--props")
    p.add_argument("--zoom")
    p.add_argument("--cat")
    p.add_argument("--bbox")
    p.add_argument("--tile", default="0/0/0")
    p.add_argument("--cluster", type=int, default=0)
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--every", type=float, default=2.0, help="watch: seconds between looks")
    p.add_argument("--times", type=int, default=0, help="watch: looks, without end if 0")
    p.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("shoal").getOrCreate()
    try:
        _show(run(spark, a), a.json, max(LIMIT, a.limit))
        looks = 1
        while a.command == "watch" and looks != a.times:
            time.sleep(a.every)
            _show(run(spark, a), a.json)
            looks += 1
    except EngineError as e:
        print(json.dumps({"error": str(e), "code": e.code}) if a.json else f"{e.code}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
