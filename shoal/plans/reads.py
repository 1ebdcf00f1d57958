"""Read queries over the stored hierarchy, all as plans over its segments (see shoal.operators.net)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.geometry import EngineError, Options, tile_unit, unproject_x, unproject_y, world_box
from shoal.operators.net import at_zoom

MAX_LEAVES = 10_000


def clusters(segs: DataFrame, opts: Options, zoom: float, cat: int | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Markers at a zoom: (collection, rep, cnt, sx, sy, one). The category is filtered before grouping, the box on the mean."""
    z = opts.level(zoom)
    points = at_zoom(segs, z)
    if cat is not None:
        points = points.where(F.col("cat") == cat)
    near = F.lit(True)
    if box is not None:
        # a cluster's points are at most four slacks apart: with its mean in the box, one is in the inner frame; and then all are in the outer
        points = points.where(_in_frame(box, 8 * opts.slack(z)))
        near = F.bool_or(_in_frame(box, 4 * opts.slack(z)))
    found = points.groupBy("collection", "rep").agg(F.count(F.lit(1)).alias("cnt"), F.sum("qx").alias("sx"), F.sum("qy").alias("sy"), F.min("num").alias("one"), near.alias("near") if box is not None else F.lit(True).alias("near"))
    if box is not None:
        x0, y0, x1, y1 = world_box(box)
        found = found.where("near").where((F.col("sx") / F.col("cnt")).between(x0, x1) & (F.col("sy") / F.col("cnt")).between(y0, y1))
    return found.drop("near").withColumn("zoom", F.lit(z))


def _in_frame(box: tuple[float, float, float, float], pad: float) -> Column:
    x0, y0, x1, y1 = world_box(box)
    return F.col("qx").between(x0 - pad, x1 + pad) & F.col("qy").between(y0 - pad, y1 + pad)


def features(found: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """What a client sees of markers: single points by their id and properties, clusters by a handle and count."""
    cluster = F.col("cnt") > 1
    out = found.select(
        "collection",
        "rep",
        cluster.alias("is_cluster"),
        F.when(~cluster, F.col("one")).alias("num"),
        F.when(cluster, F.col("rep") * 32 + F.col("zoom")).alias("cluster_id"),
        F.col("cnt").alias("count"),
        unproject_x(F.col("sx") / F.col("cnt")).alias("lng"),
        unproject_y(F.col("sy") / F.col("cnt")).alias("lat"),
    )
    if devices is None:
        return out.withColumn("device", F.col("num").cast("string")).withColumn("props", F.lit(None).cast("string"))
    names = devices.select("collection", "num", F.col("id").alias("device"), "props")
    return out.join(names, ["collection", "num"], "left")


def handle(nodes: DataFrame, cluster_id: int, collection: str) -> tuple[int, int]:
    """(representative, zoom) of a collection's handle; refused unless that point is live and a center at that zoom."""
    rep, zoom = divmod(cluster_id, 32)
    found = nodes.where((F.col("collection") == collection) & (F.col("num") == rep) & (F.col("tz") <= zoom)).head(1)
    if not found:
        raise EngineError("not_found", "no such cluster")
    return rep, zoom


def expansion_zooms(nodes: DataFrame, opts: Options, zoom: int) -> DataFrame:
    """(collection, rep, expansion): for every center of a zoom the zoom at which it splits; max_zoom + 1 if it never does."""
    kids = nodes.where(F.col("tz") > zoom).groupBy("collection", F.col("parent").alias("rep")).agg(F.min("tz").alias("expansion"))
    centers = nodes.where(F.col("tz") <= zoom).select("collection", F.col("num").alias("rep"))
    return centers.join(kids, ["collection", "rep"], "left").select("collection", "rep", F.coalesce("expansion", F.lit(opts.max_zoom + 1)).alias("expansion"))


def children(segs: DataFrame, nodes: DataFrame, opts: Options, cluster_id: int, collection: str) -> DataFrame:
    """The markers into which a collection's cluster splits, at its expansion zoom; if it never splits, its own point alone."""
    rep, zoom = handle(nodes, cluster_id, collection)
    segs, nodes = (x.where(F.col("collection") == collection) for x in (segs, nodes))
    split = nodes.where((F.col("parent") == rep) & (F.col("tz") > zoom)).agg(F.min("tz")).first()[0]
    if split is None or split > opts.max_zoom:
        own = nodes.where(F.col("num") == rep)
        return own.select("collection", F.col("num").alias("rep"), F.lit(1).cast("bigint").alias("cnt"), F.col("qx").alias("sx"), F.col("qy").alias("sy"), F.col("num").alias("one"), F.lit(opts.max_zoom).alias("zoom"))
    inside = at_zoom(segs, split).join(at_zoom(segs, zoom).where(F.col("rep") == rep).select("collection", "num"), ["collection", "num"], "left_semi")
    found = inside.groupBy("collection", "rep").agg(F.count(F.lit(1)).alias("cnt"), F.sum("qx").alias("sx"), F.sum("qy").alias("sy"), F.min("num").alias("one"))
    return found.withColumn("zoom", F.lit(split))


def leaves(segs: DataFrame, nodes: DataFrame, cluster_id: int, collection: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of a collection's cluster's points, by number."""
    rep, zoom = handle(nodes, cluster_id, collection)
    limit = 10 if limit is None or limit < 0 else min(limit, MAX_LEAVES)
    return at_zoom(segs, zoom).where((F.col("collection") == collection) & (F.col("rep") == rep)).orderBy("num").offset(max(0, offset or 0)).limit(limit)


def cluster_of(segs: DataFrame, opts: Options, num: Column, zoom: float, collection: str) -> DataFrame:
    """The marker that holds a device of a collection at a zoom."""
    z = opts.level(zoom)
    segs = segs.where(F.col("collection") == collection)
    mine = at_zoom(segs, z).where(F.col("num") == num).select("collection", "rep")
    return clusters(segs, opts, z).join(mine, ["collection", "rep"], "left_semi")


def contains(devices: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(collection, id) with whether each is live now."""
    live = devices.select("collection", "id", F.lit(True).alias("live"))
    return ids.join(live, ["collection", "id"], "left").withColumn("live", F.coalesce("live", F.lit(False)))


def centers_per_level(nodes: DataFrame, opts: Options) -> DataFrame:
    """(collection, level, centers): how many points are centers at each level; the last level has all points."""
    spread = nodes.groupBy("collection", "tz").count().select("collection", "count", F.explode(F.sequence("tz", F.lit(opts.max_zoom + 1))).alias("level"))
    return spread.groupBy("collection", "level").agg(F.sum("count").alias("centers"))


def memory_bytes(nodes: DataFrame, devices: DataFrame, opts: Options) -> DataFrame:
    """(collection, memory_bytes): an estimate of what a collection takes in the live engine - 56 bytes a node, 16 a grid entry,
    and its names and properties."""
    held = nodes.groupBy("collection").agg(F.sum(F.lit(56) + 16 * F.greatest(F.lit(opts.max_zoom + 1) - F.col("tz"), F.lit(0))).cast("bigint").alias("m"))
    text = devices.groupBy("collection").agg(F.sum(F.coalesce(F.octet_length("id"), F.lit(0)) + F.coalesce(F.octet_length("props"), F.lit(0))).cast("bigint").alias("t"))
    return held.join(text, "collection", "left").select("collection", (F.col("m") + F.coalesce("t", F.lit(0))).alias("memory_bytes"))


def grid_entries(nodes: DataFrame, opts: Options) -> DataFrame:
    return nodes.groupBy("collection").agg(F.sum(F.greatest(F.lit(opts.max_zoom + 1) - F.col("tz"), F.lit(0)).cast("bigint")).alias("entries"))


def tile_features(segs: DataFrame, opts: Options, zoom: int, cat: int | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """All tiles of a zoom (of those markers that are in the box, if any): each marker in every tile whose box, padded by the marker's radius, holds its mean.

    (collection, tx, ty, rep, x, y, cnt, one, zoom); x and y in tile units, which may lie outside 0 to extent."""
    if not 0 <= zoom <= 20:
        raise EngineError("bad_request", "zoom must be within 0 and 20")
    found = clusters(segs, opts, zoom, cat, box)
    pad, n = opts.radius / opts.extent, 1 << zoom
    mx, my = F.col("sx") / F.col("cnt"), F.col("sy") / F.col("cnt")
    place = lambda v: v / float(1 << 30) * float(n)
    tiles = lambda v: F.explode(F.sequence(F.greatest(F.ceil(place(v) - 1 - pad), F.lit(0)), F.least(F.floor(place(v) + pad), F.lit(n - 1))))
    both = found.withColumn("tx", tiles(mx)).withColumn("ty", tiles(my))
    return both.withColumn("x", tile_unit(mx, F.col("tx"), zoom, opts.extent)).withColumn("y", tile_unit(my, F.col("ty"), zoom, opts.extent))
