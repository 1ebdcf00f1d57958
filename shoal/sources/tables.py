"""Stored tables: the shared folder, and tables that are built once and read often."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. If it is unset, a local one with a local master (tests),
    and an error on a cluster, where executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shoal-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table into the shared folder and read it back; it cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    read = df.sparkSession.read.parquet if partition_by else df.sparkSession.read.schema(df.schema).parquet
    return read(path).select(df.columns)


_BUILT: dict[tuple, tuple[tuple, DataFrame]] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files, as they are now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def built(spark: SparkSession, key: tuple, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stored index that several queries of one application read: the first one builds it, and again if the table at path changed."""
    key, now = (spark.sparkContext.applicationId, *key), state_of(spark, path)
    if key not in _BUILT or _BUILT[key][0] != now:
        _BUILT[key] = now, make()
    return _BUILT[key][1]
