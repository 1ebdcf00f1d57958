"""Snapshots of live devices: Parquet in a folder for each collection, with the options and sizes beside it."""

from __future__ import annotations

import dataclasses
import json
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.geometry import EngineError, Options
from shoal.operators.state import micros, number_rows
from shoal.sources.tables import materialise

COLUMNS = ("collection", "num", "id", "qx", "qy", "cat", "last_seen", "props")
_SCHEMA = "collection string, num bigint, id string, qx bigint, qy bigint, cat int, last_seen timestamp_ntz, props string"
_META = "collection string, config string, devices bigint"


def encoded(name: Column) -> Column:
    """``encode_name`` as a column."""
    safe = F.regexp_replace(F.regexp_replace(F.url_encode(name), r"\+", "%20"), r"\*", "%2A")
    safe = F.when(safe.startswith("."), F.concat(F.lit("%2E"), F.substring(safe, 2, 1 << 20))).otherwise(safe)
    short = F.concat(F.substring(safe, 1, 160), F.lit("-"), F.substring(F.sha2(name, 256), 1, 16))
    return F.when(name == "", F.lit("%00")).when(F.length(safe) > 200, short).otherwise(safe)


def _parts(df: DataFrame):
    """A writer that replaces the folders of just those collections that df has."""
    return df.withColumn("part", encoded(F.col("collection"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part")


def write(devices: DataFrame, path: str, options: dict[str, Options] | None = None) -> str:
    """Replace the snapshot of every collection that devices has, or options names; all other collections, and their options,
    stay. Spark's commit makes that whole or nothing. The number of devices is kept beside the options, so that a reader
    notices a part that is missing."""
    spark = devices.sparkSession
    stored = materialise(devices.select(*(F.col(c) for c in COLUMNS)).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz")), "snapshot")
    found = {r[0]: r[1] for r in stored.groupBy("collection").count().collect()}  # a row a collection
    old = read_options(spark, path)
    for name in set(options or {}) - set(found):  # nothing is left of it
        delete(spark, path, name, keep_options=True)
    _parts(stored).parquet(f"{path}/devices")
    meta = [(name, _config((options or {}).get(name) or old.get(name) or Options()), found.get(name, 0)) for name in sorted({*found, *(options or {})})]
    if meta:
        _parts(spark.createDataFrame(meta, _META)).json(f"{path}/collections")
    return path


def write_options(spark: SparkSession, path: str, name: str, opts: Options) -> None:
    """A collection without devices."""
    write(spark.createDataFrame([], _SCHEMA), path, {name: opts})


def _config(opts: Options) -> str:
    return json.dumps(dataclasses.asdict(opts))


def merge(changes: DataFrame, path: str, options: dict[str, Options] | None = None) -> str:
    """Bring a snapshot up to date: changes(COLUMNS, live) replace the stored rows of the same ids, those not live remove them.
    Of the collections that changes names all other devices stay."""
    spark = changes.sparkSession
    changes = materialise(changes.select(*COLUMNS, "live"), "changes")
    names = changes.select("collection").distinct()
    old = read(spark, path).join(names, "collection", "left_semi")
    kept = old.join(changes.select("collection", "id"), ["collection", "id"], "left_anti").select(*COLUMNS)
    touched = {r[0] for r in names.collect()}
    known = read_options(spark, path) | (options or {})
    new = kept.unionByName(changes.where("live").select(*COLUMNS))
    return write(new, path, {n: known.get(n) or Options() for n in touched})


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """The devices of a snapshot; snapshots from before properties were kept have null ones. No snapshot is an empty one.

    skip_corrupt: leave out what cannot be read instead of failing (see ``read_sound``)."""
    if not _exists(spark, f"{path}/devices"):
        return spark.createDataFrame([], _SCHEMA)
    found = spark.read.schema(_SCHEMA).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    return found.parquet(f"{path}/devices").select(*COLUMNS)


def _meta(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/collections"):
        return spark.createDataFrame([], _META)
    return spark.read.schema(_META).json(f"{path}/collections").select("collection", "config", "devices").where("collection IS NOT NULL")


def read_options(spark: SparkSession, path: str) -> dict[str, Options]:
    out = {}
    for name, config, _ in _meta(spark, path).collect():
        d = json.loads(config)
        out[name] = Options(**d | {"categories": tuple(d["categories"])})
    return out


def read_sound(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(the devices of all collections that can be read whole, the names of the others, which start empty)."""
    found = read(spark, path, skip_corrupt=True)
    have = found.groupBy("collection").count()
    both = _meta(spark, path).select("collection", "devices").join(have, "collection", "full")
    odd = both.where(F.coalesce("devices", F.lit(-1)) != F.coalesce("count", F.lit(0))).select("collection")
    names = sorted(r[0] for r in odd.collect())
    return found.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "collection string")), "collection", "left_anti").select(*COLUMNS), names


def info(spark: SparkSession, path: str) -> DataFrame:
    """(collection, devices, snapshot_bytes, snapshot_last_success): what a snapshot holds, and when it was written."""
    if not _exists(spark, f"{path}/devices"):
        return spark.createDataFrame([], "collection string, devices bigint, snapshot_bytes bigint, snapshot_last_success timestamp")
    rows = spark.read.schema(_SCHEMA).parquet(f"{path}/devices").select("collection", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = rows.groupBy("collection", "file_path").agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("size"), F.max("file_modification_time").alias("at"))
    return files.groupBy("collection").agg(F.sum("n").alias("devices"), F.sum("size").alias("snapshot_bytes"), F.max("at").alias("snapshot_last_success"))


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names of the collections that have a snapshot, sorted; one without devices has one too."""
    names = read(spark, path).select("collection").union(_meta(spark, path).select("collection"))
    return [r[0] for r in names.distinct().orderBy("collection").collect()]


def restore(devices: DataFrame, opts: Options, as_of) -> DataFrame:
    """What a restart brings back: devices within the time to live, unknown categories as 0, numbered anew from 0."""
    fresh = devices
    if opts.ttl_seconds:
        fresh = devices.where(micros(F.col("last_seen")) >= micros(as_of) - opts.ttl_seconds * 1_000_000)
    known = max(1, len(opts.categories))
    kept = F.when((F.col("cat") >= 0) & (F.col("cat") < known), F.col("cat")).otherwise(F.lit(0)) if opts.categories else F.col("cat")
    old = fresh.withColumn("cat", kept).withColumnRenamed("num", "old_num")
    return number_rows(old, "collection", "old_num").select(devices.columns)


def encode_name(name: str) -> str:
    """A collection's name as one safe path part; long ones end in a digest."""
    import hashlib

    if not name:
        return "%00"
    safe = quote(name, safe="-_.").replace("~", "%7E")
    if safe.startswith("."):
        safe = "%2E" + safe[1:]
    return safe if len(safe) <= 200 else f"{safe[:160]}-{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def decode_name(part: str) -> str:
    if part == "%00":
        return ""
    return unquote(part)


def delete(spark: SparkSession, path: str, collection: str, keep_options: bool = False) -> None:
    """Drop a collection's snapshot and options; one that is not there is no error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    try:
        for table in ("devices", *(() if keep_options else ("collections",))):
            part = hadoop.Path(f"{path}/{table}", f"part={root.escapePathName(encode_name(collection))}")
            part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True)
    except Exception as e:  # the Java side raises one error type for everything
        raise EngineError("snapshot_failed", str(e)) from e
