"""Devices from their reports: interning, lives, latest state, expiry, and coalescing.

A device's life begins with its first report, or with the first after a removal or after a silence longer than the time to
live. Within a life the last position counts, the first category, and the last properties that were not left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.sources.tables import materialise

_DEVICE = ("collection", "id")


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone (the session's zone is UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def number_rows(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with ``num``: the rank from 0 of a row within its ``by``, in ``order``.

    Rows are dealt by ranges and ranked within a range; the ranges' sizes, a row each, then give the offsets. So one large
    group is ranked by many tasks."""
    ranged = df.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    sizes = ranged.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order))
    both = ranged.withColumn("_rank", rank).join(offsets, [by, "_range"])
    return both.select(*df.columns, (F.col("_offset") + F.col("_rank") - 1).cast("bigint").alias("num"))


def intern_ids(reports: DataFrame) -> DataFrame:
    """(collection, id, num): numbers from 0 in the order in which a collection first saw its devices, never used again."""
    first = reports.where("op = 'upsert'").groupBy(*_DEVICE).agg(F.min("seq").alias("first_seq"))
    return number_rows(first, "collection", "first_seq").select(*_DEVICE, "num")


def lives(reports: DataFrame, ttl_seconds: int) -> DataFrame:
    """Reports with the number of the life that they belong to; a removal ends the life that it is in."""
    w = Window.partitionBy(*_DEVICE).orderBy("seq")
    silent = micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w) > ttl_seconds * 1_000_000 if ttl_seconds else F.lit(False)
    begins = F.lag("op").over(w).isNull() | (F.lag("op").over(w) == "remove") | silent
    return reports.withColumn("life", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("bigint"))


def life_states(with_life: DataFrame) -> DataFrame:
    """One row per life: where it ended, and what it kept. Aggregates only, so that one busy device combines map-side."""
    up = F.col("op") == "upsert"
    last = F.max_by(F.struct("qx", "qy"), F.when(up, F.col("seq")))
    return with_life.groupBy(*_DEVICE, "life").agg(
        last.alias("at"),
        F.min_by("cat", F.when(up, F.col("seq"))).alias("cat"),
        F.max_by("props", F.when(up & F.col("props").isNotNull(), F.col("seq"))).alias("props"),
        F.max(F.when(up, F.col("ts"))).alias("last_seen"),
        F.min("ts").alias("first_seen"),
        F.sum(up.cast("bigint")).alias("reports"),
        F.max_by("op", "seq").alias("ended"),
    ).select(*_DEVICE, "life", F.col("at.qx").alias("qx"), F.col("at.qy").alias("qy"), "cat", "props", "first_seen", "last_seen", "reports", "ended")


def live_devices(reports: DataFrame, ttl_seconds: int, as_of) -> DataFrame:
    """The devices that are live as of a time: their last life was not removed and is not older than the time to live."""
    past = reports.where(F.col("ts") <= as_of)
    all_lives = life_states(lives(past, ttl_seconds))
    newest = all_lives.groupBy(*_DEVICE).agg(F.max("life").alias("life"))
    fresh = micros(F.col("last_seen")) >= micros(as_of) - ttl_seconds * 1_000_000 if ttl_seconds else F.lit(True)
    return all_lives.join(newest, [*_DEVICE, "life"]).where((F.col("ended") == "upsert") & fresh).drop("ended")


def expired(reports: DataFrame, ttl_seconds: int, as_of) -> DataFrame:
    """Devices that a sweep at that time drops."""
    last = reports.where(F.col("ts") <= as_of).groupBy(*_DEVICE).agg(F.max("ts").alias("last_seen"), F.max_by("op", "seq").alias("op"))
    return last.where((F.col("op") == "upsert") & (micros(F.col("last_seen")) < micros(as_of) - ttl_seconds * 1_000_000)).drop("op")


def coalesce_reports(reports: DataFrame, flush: str) -> DataFrame:
    """Per flush window and device the newest report, with the newest properties of the window."""
    win = F.window("ts", flush).alias("w")
    out = reports.where("op = 'upsert'").groupBy(*_DEVICE, win).agg(
        F.max_by(F.struct("qx", "qy", "cat", "seq"), "seq").alias("r"),
        F.max_by("props", F.when(F.col("props").isNotNull(), F.col("seq"))).alias("props"),
        F.count(F.lit(1)).alias("queued"),
    )
    return out.select(*_DEVICE, F.col("w.start").alias("flush"), "r.*", "props", "queued", (F.col("queued") - 1).alias("merged"))


def chunked(reports: DataFrame, size: int) -> DataFrame:
    """reports with ``chunk``: which of a collection's write batches of at most so many reports, in the order of seq, each is in."""
    return number_rows(reports.drop("num"), "collection", "seq").withColumn("chunk", F.floor(F.col("num") / size)).drop("num")


def life_counts(reports: DataFrame, ttl_seconds: int, as_of) -> DataFrame:
    """(collection, devices, reports, inserts, removes, expired, moves): what a replay counts, from windows and aggregates alone.

    A life begins with an upsert; it ended by a removal, or because its device was silent for longer than the time to live
    before its next report or, at the end, before as_of."""
    w = Window.partitionBy(*_DEVICE, "life").orderBy("seq")
    marked = lives(reports, ttl_seconds).withColumn("moved", F.coalesce((F.col("op") == "upsert") & (F.lag("op").over(w) == "upsert") & ((F.lag("qx").over(w) != F.col("qx")) | (F.lag("qy").over(w) != F.col("qy"))), F.lit(False)))
    moves = marked.groupBy(*_DEVICE, "life").agg(F.sum(F.col("moved").cast("bigint")).alias("moves"))
    each = life_states(marked).where("reports > 0").join(moves, [*_DEVICE, "life"])
    newest = marked.groupBy(*_DEVICE).agg(F.max("life").alias("newest"))
    each = each.join(newest, list(_DEVICE))
    stale = micros(F.col("last_seen")) < micros(as_of) - ttl_seconds * 1_000_000 if ttl_seconds else F.lit(False)
    removed = F.col("ended") == "remove"
    expired = ~removed & ((F.col("life") < F.col("newest")) | stale)
    total = lambda c: F.sum(c.cast("bigint"))
    out = each.groupBy("collection").agg(
        total(~removed & ~expired).alias("devices"),
        total(F.col("reports")).alias("reports"),
        F.count(F.lit(1)).alias("inserts"),
        total(removed | expired).alias("removes"),
        total(expired).alias("expired"),
        total(F.col("moves")).alias("moves"),
    )
    return out
