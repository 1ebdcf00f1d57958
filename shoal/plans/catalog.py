"""Collections: creating, dropping, listing, their statistics, health, and metrics in the Prometheus text format."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.geometry import EngineError, Options
from shoal.operators.state import number_rows
from shoal.sources import snapshot
from shoal.sources.tables import materialise


@dataclass
class Catalog:
    """Names and options of the collections of an engine; with a path they are those of the snapshot that is stored there."""

    auto_create: bool = True
    collections: dict[str, Options] = field(default_factory=dict)
    spark: SparkSession | None = None
    path: str | None = None

    @classmethod
    def stored(cls, spark: SparkSession, path: str, auto_create: bool = True) -> Catalog:
        return cls(auto_create, snapshot.read_options(spark, path), spark, path)

    def create(self, name: str, opts: Options | None = None) -> bool:
        """Whether it is new; the same geometry again changes nothing, another one is a conflict."""
        opts = opts or Options()
        old = self.collections.get(name)
        if old is None:
            self.collections[name] = opts
            if self.path:
                snapshot.write_options(self.spark, self.path, name, opts)
            return True
        if not old.same_geometry(opts):
            raise EngineError("conflict", f"collection {name} exists with another geometry")
        return False

    def get(self, name: str) -> Options:
        if name not in self.collections:
            raise EngineError("no_such_collection", f"there is no collection {name}")
        return self.collections[name]

    def for_write(self, name: str) -> Options:
        if name not in self.collections and self.auto_create:
            self.create(name)
        return self.get(name)

    def drop(self, name: str) -> None:
        """The collection goes, with its options and its snapshot."""
        self.get(name)
        del self.collections[name]
        if self.path:
            snapshot.delete(self.spark, self.path, name)

    def names(self) -> list[str]:
        return sorted(self.collections)

    def ingest(self, name: str, ok: DataFrame, at=None) -> DataFrame:
        """Take accepted reports(batch, at, id, qx, qy, cat, props) into a stored collection, which is made if need be: the last
        position counts, the first category, the last properties that were not left out, and numbers go on. Returns what changed."""
        opts = self.for_write(name)
        order, given = F.struct("batch", "at"), F.col("props").isNotNull()
        new = ok.groupBy("id").agg(
            F.max_by(F.struct("qx", "qy"), order).alias("r"),
            F.min_by("cat", order).alias("cat"),
            F.max_by("props", F.when(given, order)).alias("props"),
            F.min(order).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
        old = snapshot.read(self.spark, self.path).where(F.col("collection") == name)
        known = old.select("id", F.col("num").alias("old_num"), F.col("cat").alias("old_cat"), F.col("props").alias("old_props"))
        both = materialise(new.join(known, "id", "left"), "ingest")
        top = old.agg(F.max("num")).first()[0]
        fresh = number_rows(both.where("old_num IS NULL").withColumn("collection", F.lit(name)), "collection", "first")
        numbered = fresh.select("id", (F.col("num") + (0 if top is None else top + 1)).alias("new_num"))
        out = both.join(numbered, "id", "left").select(
            F.lit(name).alias("collection"),
            F.coalesce("old_num", "new_num").alias("num"),
            "id",
            "r.qx",
            "r.qy",
            F.coalesce("old_cat", "cat").alias("cat"),
            (F.current_timestamp() if at is None else at).cast("timestamp_ntz").alias("last_seen"),
            F.coalesce("props", "old_props").alias("props"),
            F.lit(True).alias("live"),
        )
        changes = materialise(out, "ingest")
        snapshot.merge(changes, self.path, {name: opts})
        return changes

    def remove(self, name: str, ident: str) -> None:
        """One device leaves a stored collection."""
        self.get(name)
        found = snapshot.read(self.spark, self.path).where((F.col("collection") == name) & (F.col("id") == ident))
        if not found.head(1):
            raise EngineError("device_not_registered", f"{ident} is not registered")
        snapshot.merge(found.withColumn("live", F.lit(False)), self.path)


def stats(devices: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per collection: live devices, bytes of properties, reports, and when it was last heard of."""
    seen = reports.groupBy("collection").agg(F.count(F.lit(1)).alias("reports"), F.sum((F.col("op") == "remove").cast("bigint")).alias("removals"), F.max("ts").alias("last_report"))
    live = devices.groupBy("collection").agg(F.count(F.lit(1)).alias("devices"), F.coalesce(F.sum(F.octet_length("props")), F.lit(0)).alias("props_bytes"))
    return seen.join(live, "collection", "left").select("collection", F.coalesce("devices", F.lit(0)).alias("devices"), F.coalesce("props_bytes", F.lit(0)).alias("props_bytes"), "reports", "removals", "last_report")


def listed(collection_stats: DataFrame) -> DataFrame:
    return collection_stats.orderBy("collection")


def health(collection_stats: DataFrame) -> DataFrame:
    return collection_stats.agg(F.lit("ok").alias("status"), F.count(F.lit(1)).alias("collections"), F.coalesce(F.sum("devices"), F.lit(0)).alias("devices"))


#: Name, kind and help of every series; those are given whose column the statistics have.
METRICS = (
    ("devices", "gauge", "live devices"),
    ("reports", "counter", "reports taken in"),
    ("removals", "counter", "devices removed on request"),
    ("props_bytes", "gauge", "bytes of properties"),
    ("expired", "counter", "devices that fell silent"),
    ("queries", "counter", "reads answered"),
    ("memory_bytes", "gauge", "estimated size in the live engine"),
    ("fast_move_ratio", "gauge", "share of the moves that changed no other point"),
    ("snapshot_last_success", "gauge", "seconds since the epoch of the newest snapshot"),
    ("snapshot_bytes", "gauge", "size of the newest snapshot"),
    ("snapshot_failures", "counter", "snapshots that failed"),
    ("restored", "gauge", "devices that the last start brought back"),
)


def metrics_text(collection_stats: DataFrame, prefix: str = "shoal") -> DataFrame:
    """(collection, metric, line): a sample line per collection and metric. Names are escaped as the format asks."""
    kinds = dict(collection_stats.dtypes)
    name = F.col("collection")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        name = F.replace(name, F.lit(plain), F.lit(escaped))
    rows = []
    for metric, *_ in METRICS:
        if metric in kinds:
            kind = kinds[metric]
            value = F.format_string("%.4f", F.col(metric)) if kind == "double" else (F.unix_seconds(F.col(metric)) if kind == "timestamp" else F.col(metric)).cast("bigint").cast("string")
            line = F.concat(F.lit(f'{prefix}_{metric}{{collection="'), name, F.lit('"} '), value)
            rows.append(F.struct(F.lit(metric).alias("metric"), line.alias("line")))
    m = F.explode(F.filter(F.array(*rows), lambda r: r["line"].isNotNull())).alias("m")
    return collection_stats.select("collection", m).select("collection", "m.metric", "m.line")


def metrics_page(lines: DataFrame, prefix: str = "shoal") -> str:
    """The exposition text; it has a few lines per collection."""
    out = []
    found = lines.orderBy("metric", "collection").collect()
    for name, kind, about in METRICS:
        lines = [r["line"] for r in found if r["metric"] == name]
        out += [f"# HELP {prefix}_{name} {about}", f"# TYPE {prefix}_{name} {kind}", *lines] if lines else []
    return "\n".join(out) + "\n"


def fast_share(counts: DataFrame) -> DataFrame:
    """(collection, fast_move_percent): 0 if nothing moved."""
    return counts.select("collection", F.when(F.col("moves") > 0, F.col("moves_fast") * 100.0 / F.col("moves")).otherwise(F.lit(0.0)).alias("fast_move_percent"))


def full_stats(plain: DataFrame, *more: DataFrame) -> DataFrame:
    """Statistics with the columns of further tables by collection (counters of a replay, memory, snapshots, reads)."""
    for df in more:
        plain = plain.join(df, "collection", "left")
    return plain


def percentiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """(by, p50, p99, …): exact percentiles of a measure, interpolated between neighbours."""
    name = lambda q: f"p{q * 100:g}".replace(".", "_")
    return df.groupBy(by).agg(*(F.percentile(value, q).alias(name(q)) for q in shares))
