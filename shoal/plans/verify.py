"""The invariants of a stored hierarchy, as queries of violations: all of them must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.geometry import Options
from shoal.operators.net import assignment, cube
from shoal.operators.search import squared_distance, within


def _scale(opts: Options, level) -> F.Column:
    return F.lit(opts.scale(0)) / F.pow(F.lit(2.0), level)


def bad_levels(nodes: DataFrame, opts: Options) -> DataFrame:
    """Nodes whose level, parent, or distance to the parent is not as it must be."""
    p = nodes.select("collection", F.col("num").alias("parent"), F.col("tz").alias("ptz"), F.col("qx").alias("px"), F.col("qy").alias("py"))
    j = nodes.join(p, ["collection", "parent"], "left")
    d2 = squared_distance(F.col("qx"), F.col("qy"), F.col("px"), F.col("py")).cast("double")
    limit = _scale(opts, F.col("tz") - 1) * (1 + opts.hysteresis)
    root = (F.col("tz") == 0) & F.col("parent").isNull()
    child = (F.col("tz") > 0) & F.col("ptz").isNotNull() & (F.col("ptz") < F.col("tz")) & (d2 <= limit * limit)
    return j.where(~F.coalesce(root | child, F.lit(False)) | ~F.col("tz").between(0, opts.max_zoom + 1)).select("collection", "num")


def bad_separation(nodes: DataFrame, opts: Options) -> DataFrame:
    """Pairs of centers of some zoom that are not more than its scale apart; found by cells, zoom by zoom."""
    found = []
    for z in range(opts.max_zoom + 1):
        c = nodes.where(F.col("tz") <= z)
        found.append(within(c, c, opts.scale(z)).where("probe < other").withColumn("zoom", F.lit(z)))
    return reduce(DataFrame.unionByName, found).select("collection", "zoom", "probe", "other")


def bad_partition(nodes: DataFrame, segs: DataFrame, opts: Options) -> DataFrame:
    """Points that some zoom does not assign exactly once, or not to a center of that zoom."""
    a = assignment(segs)
    n = nodes.select("collection", F.col("num").alias("rep"), "tz")
    seen = a.join(n, ["collection", "rep"]).where("tz <= zoom").groupBy("collection", "num").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("zoom").alias("d"))
    want = opts.max_zoom + 1
    return nodes.join(seen, ["collection", "num"], "left").where((F.coalesce("n", F.lit(0)) != want) | (F.coalesce("d", F.lit(0)) != want)).select("collection", "num")


def bad_radius(nodes: DataFrame, segs: DataFrame, opts: Options) -> DataFrame:
    """Points further from their representative than twice the slack of the zoom."""
    n = nodes.select("collection", F.col("num").alias("rep"), F.col("qx").alias("px"), F.col("qy").alias("py"))
    j = assignment(segs).join(n, ["collection", "rep"])
    limit = _scale(opts, F.col("zoom")) * (2 * (1 + opts.hysteresis))
    return j.where(squared_distance(F.col("qx"), F.col("qy"), F.col("px"), F.col("py")).cast("double") > limit * limit).select("collection", "zoom", "num")


def bad_slices(segs: DataFrame) -> DataFrame:
    """Clusters whose categories do not add up to the whole."""
    c = cube(segs)
    parts = c.where("whole = 0").groupBy("collection", "zoom", "rep").agg(*(F.sum(x).alias(x) for x in ("cnt", "sx", "sy")))
    whole = c.where("whole = 1").select("collection", "zoom", "rep", *(F.col(x).alias(f"w_{x}") for x in ("cnt", "sx", "sy")))
    same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"w_{x}")) for x in ("cnt", "sx", "sy")))
    return whole.join(parts, ["collection", "zoom", "rep"], "left").where(~same).select("collection", "zoom", "rep")


def unreachable(nodes: DataFrame, segs: DataFrame) -> DataFrame:
    """Nodes whose walk up the parents does not end at a root: nothing represents them at the coarsest zoom."""
    home = segs.where("low = 0").select("collection", "num").distinct()
    return nodes.join(home, ["collection", "num"], "left_anti").select("collection", "num")


def bad_grid(nodes: DataFrame, segs: DataFrame, opts: Options) -> DataFrame:
    """Collections whose centers, counted by levels, are not those that the zooms' assignments use."""
    want = nodes.groupBy("collection").agg(F.sum(F.greatest(F.lit(opts.max_zoom + 1) - F.col("tz"), F.lit(0)).cast("bigint")).alias("want"))
    used = assignment(segs).groupBy("collection", "zoom").agg(F.count_distinct("rep").alias("n")).groupBy("collection").agg(F.sum("n").alias("used"))
    return want.join(used, "collection", "left").where(F.col("want") != F.coalesce("used", F.lit(0))).select("collection")


def verify(nodes: DataFrame, segs: DataFrame, opts: Options) -> DataFrame:
    """(invariant, violations), one row for each invariant."""
    checks = {
        "covering": bad_levels(nodes, opts),
        "separation": bad_separation(nodes, opts),
        "partition": bad_partition(nodes, segs, opts),
        "radius": bad_radius(nodes, segs, opts),
        "slices": bad_slices(segs),
        "reachable": unreachable(nodes, segs),
        "grid": bad_grid(nodes, segs, opts),
    }
    return reduce(DataFrame.unionByName, (v.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k).alias("invariant"), "violations") for k, v in checks.items()))
