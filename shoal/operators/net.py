"""The hierarchy of nets: bulk build, representatives, and the cube of clusters.

The net of a zoom is the lexicographically first maximal independent set (in the order of arrival) of the next finer net, where
two points conflict if they are within the zoom's scale. A point's level ``tz`` is the coarsest zoom whose net has it
(max_zoom + 1 if none has); its parent is the nearest earlier center of zoom tz - 1. While a collection is large, a net is
found in rounds of equi-joins on grid cells: a point joins when no earlier undecided point is within the scale, and whatever it
covers drops out. A collection, or what is left of it at coarser zooms, that has at most ``LOCAL_LIMIT`` points is done by the
same rounds in numpy, in one task (shoal.operators.bulk).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.geometry import Options
from shoal.operators import bulk
from shoal.operators.search import squared_distance, with_cell, with_near_cells
from shoal.sources.tables import materialise

LOCAL_LIMIT = 250_000
NODE_SCHEMA = "collection string, num bigint, qx bigint, qy bigint, cat int, tz int, parent bigint"
SEGMENT_SCHEMA = "collection string, num bigint, qx bigint, qy bigint, cat int, rep bigint, low int, high int"


def _local(opts: Options):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("num", ignore_index=True)
        num = pdf["num"].to_numpy(np.int64)
        level, parent = bulk.build(num, pdf["qx"].to_numpy(np.int64), pdf["qy"].to_numpy(np.int64), opts)
        out = pdf[["collection", "num", "qx", "qy", "cat"]].copy()
        out["tz"] = level
        out["parent"] = pd.array(np.where(parent < 0, 0, num[parent]), "Int64")
        out.loc[parent < 0, "parent"] = pd.NA
        return out

    return run


def _most(points: DataFrame) -> int:
    """Rows of the largest collection."""
    return points.groupBy("collection").count().agg(F.max("count")).first()[0] or 0


def _local_set(radius: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("num", ignore_index=True)
        chosen = bulk.first_independent_set(pdf["qx"].to_numpy(np.int64), pdf["qy"].to_numpy(np.int64), radius)
        return pdf.loc[chosen, ["collection", "num"]]

    return run


def _first_independent_set(points: DataFrame, radius: float, local_limit: int) -> DataFrame:
    """The lexicographically first maximal independent set by num, in rounds. points(collection, num, qx, qy, cat).

    Only the earliest point of each cell so small that its points always conflict goes to others, four coarse cells a point at
    most. Once collections have at most local_limit undecided points, a task each does the rest. No side of a join goes to the
    driver: both grow with the input."""
    fine, side = radius / math.sqrt(2) * 0.999999, 2 * radius
    undecided = points.select("collection", "num", "qx", "qy")
    chosen = []
    while left := _most(undecided):
        if left <= local_limit:
            chosen.append(undecided.groupBy("collection").applyInPandas(_local_set(radius), "collection string, num bigint"))
            break
        ahead = with_cell(undecided, fine).groupBy("collection", "cx", "cy").agg(F.min_by(F.struct("num", "qx", "qy"), "num").alias("p")).select("collection", "p.*")
        ahead = materialise(ahead, "ahead")
        open_ = with_cell(undecided, side)
        probe = with_near_cells(ahead, radius, side).withColumnsRenamed({"num": "probe", "qx": "px", "qy": "py"})
        d2 = squared_distance(F.col("px"), F.col("py"), F.col("qx"), F.col("qy")).cast("double")
        near = open_.join(probe.hint("merge"), ["collection", "cx", "cy"]).where(d2 <= radius * radius)
        waiting = near.where("num < probe").select("collection", F.col("probe").alias("num")).distinct()
        joins = materialise(ahead.join(waiting.hint("merge"), ["collection", "num"], "left_anti"), "chosen")
        chosen.append(joins.select("collection", "num"))
        cover = with_near_cells(joins, radius, side).withColumnsRenamed({"num": "center", "qx": "px", "qy": "py"})
        gone = open_.join(cover.hint("merge"), ["collection", "cx", "cy"]).where(d2 <= radius * radius).select("collection", "num").distinct()
        undecided = materialise(undecided.join(gone.hint("merge"), ["collection", "num"], "left_anti"), "undecided")
    return points.join(reduce(DataFrame.unionByName, chosen).hint("merge"), ["collection", "num"], "left_semi")


def _hang(children: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """children with the nearest earlier center within the radius; ties by the id as text."""
    side = 2 * radius
    p = with_near_cells(children, radius, side)
    c = with_cell(centers.select("collection", F.col("num").alias("center"), F.col("qx").alias("px"), F.col("qy").alias("py"), "qx", "qy"), side).drop("qx", "qy")
    d2 = squared_distance(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
    met = p.join(c.hint("merge"), ["collection", "cx", "cy"]).withColumn("d2", d2).where((F.col("d2").cast("double") <= radius * radius) & (F.col("center") < F.col("num")))
    best = F.min(F.struct("d2", F.col("center").cast("string").alias("t"), "center")).alias("b")
    return met.groupBy("collection", "num").agg(best).select("collection", "num", F.col("b.center").alias("parent"))


def build_nodes(points: DataFrame, opts: Options, local_limit: int = LOCAL_LIMIT) -> DataFrame:
    """Nodes of points(collection, num, qx, qy, cat), inserted in the order of num, without duplicates of num."""
    points = materialise(points.select("collection", F.col("num").cast("bigint"), F.col("qx").cast("bigint"), F.col("qy").cast("bigint"), F.coalesce("cat", F.lit(0)).cast("int").alias("cat")), "points")
    out = []
    for z in range(opts.max_zoom, -1, -1):
        if _most(points) <= local_limit:
            coarse = Options(max_zoom=z, radius=opts.radius, extent=opts.extent, hysteresis=opts.hysteresis)
            out.append(points.groupBy("collection").applyInPandas(_local(coarse), NODE_SCHEMA))
            return materialise(reduce(DataFrame.unionByName, out), "nodes")
        centers = materialise(_first_independent_set(points, opts.scale(z), local_limit), "centers")
        rest = points.join(centers.select("collection", "num").hint("merge"), ["collection", "num"], "left_anti")
        hung = _hang(rest, centers, opts.scale(z))
        out.append(rest.join(hung.hint("merge"), ["collection", "num"]).select("collection", "num", "qx", "qy", "cat", F.lit(z + 1).alias("tz"), "parent"))
        points = centers
    out.append(points.select("collection", "num", "qx", "qy", "cat", F.lit(0).alias("tz"), F.lit(None).cast("bigint").alias("parent")))
    return materialise(reduce(DataFrame.unionByName, out), "nodes")


def _walks(opts: Options):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("num", ignore_index=True)
        num, tz = pdf["num"].to_numpy(np.int64), pdf["tz"].to_numpy(np.int64)
        up = np.searchsorted(num, pdf["parent"].fillna(-1).to_numpy(np.int64))
        root = pdf["parent"].isna().to_numpy()
        at, rep, high = np.arange(len(num)), np.arange(len(num)), np.full(len(num), opts.max_zoom)
        parts = []
        while len(at):
            low = tz[rep]
            seen = low <= high
            parts.append((at[seen], rep[seen], low[seen], high[seen]))
            more = ~root[rep]
            at, rep, high = at[more], up[rep[more]], low[more] - 1
        at, rep, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = pdf[["collection", "num", "qx", "qy", "cat"]].iloc[at].reset_index(drop=True)
        out["rep"], out["low"], out["high"] = num[rep], low, high
        return out

    return run


def segments(nodes: DataFrame, opts: Options, local_limit: int = LOCAL_LIMIT) -> DataFrame:
    """For each point and each of its ancestors (itself too) the zooms low..high at which that is its representative.

    Collections of at most local_limit points are walked each in one task. For larger ones it is one join a step up the
    hierarchy, on the ancestor; each step is stored, and steps end when all walks are at a root."""
    if _most(nodes) <= local_limit:
        return materialise(nodes.groupBy("collection").applyInPandas(_walks(opts), SEGMENT_SCHEMA), "segments")
    up = nodes.select("collection", F.col("num").alias("rep"), F.col("tz").alias("low"), F.col("parent"))
    walk = nodes.select("collection", "num", "qx", "qy", "cat", F.col("num").alias("rep"), F.col("tz").alias("low"), F.lit(opts.max_zoom).alias("high"), "parent")
    out = []
    for _ in range(opts.max_zoom + 3):  # levels fall towards a root, unless a number stands twice
        out.append(walk.where("low <= high").select("collection", "num", "qx", "qy", "cat", "rep", "low", "high"))
        climbing = walk.where("parent IS NOT NULL").select("collection", "num", "qx", "qy", "cat", F.col("parent").alias("rep"), (F.col("low") - 1).alias("high"))
        walk = materialise(climbing.join(up.hint("merge"), ["collection", "rep"]), "walk")
        if not walk.head(1):
            return materialise(reduce(DataFrame.unionByName, out), "segments")
    raise ValueError("parents do not lead to roots: numbers of points must be unique in a collection")


def at_zoom(segs: DataFrame, zoom: int) -> DataFrame:
    """(collection, num, qx, qy, cat, rep): every point with its representative at a zoom."""
    return segs.where((F.col("low") <= zoom) & (F.col("high") >= zoom)).drop("low", "high")


def assignment(segs: DataFrame) -> DataFrame:
    """(collection, zoom, num, rep, …) for all zooms."""
    return segs.withColumn("zoom", F.explode(F.sequence("low", "high"))).drop("low", "high")


def fingerprints(segs: DataFrame) -> DataFrame:
    """(collection, zoom, points, fingerprint): which point has which representative, to compare whole hierarchies.

    An exclusive or of digests, so that it combines in any order and no group is gathered."""
    pair = F.concat(F.col("num").cast("string"), F.lit(">"), F.col("rep").cast("string"))
    part = F.conv(F.substring(F.md5(pair), 1, 15), 16, 10).cast("bigint")
    return assignment(segs).groupBy("collection", "zoom").agg(F.count(F.lit(1)).alias("points"), F.bit_xor(part).alias("fingerprint"))


def cube(segs: DataFrame) -> DataFrame:
    """Clusters of all zooms, whole (cat null) and by category, in one grouping-sets aggregation."""
    a = assignment(segs).select("collection", "zoom", "rep", "cat", "qx", "qy")
    sets = [["collection", "zoom", "rep"], ["collection", "zoom", "rep", "cat"]]
    grouped = a.groupingSets([[F.col(c) for c in s] for s in sets], "collection", "zoom", "rep", "cat")
    return grouped.agg(F.count(F.lit(1)).alias("cnt"), F.sum("qx").alias("sx"), F.sum("qy").alias("sy"), F.grouping("cat").cast("int").alias("whole"))
