"""Exact top-k search by inner product, over a KD-tree per shard.

Vectors are turned into integers and dealt to shards by a coarse KD split, so that a shard's vectors lie together and its
bounding box is tight; the split is fitted on a bounded sample (``SAMPLE`` vectors a length), and every vector is placed by it. Each
shard builds a KD-tree: median splits on the widest dimension down to small leaves, with the tight bounding box of every node.
A query walks a tree best first: a node's bound is the largest inner product that its box allows, and the walk ends when the
best bound left is below the query's kth score. A query first searches its own shard; with the kth score that it finds there
the shards whose boxes cannot reach it are ruled out before anything is sent (while the boxes are at most ``BOX_BYTES``; beyond
that the walks themselves end at the root), and walks elsewhere start with it. Queries travel in blocks of bounded size, and a task
holds one shard and a bounded number of blocks.

Rows with a null id, a null vector, or a null or non-finite component take no part; vectors are compared with vectors of
their own length only. Rows that share the query's id are the query's own. Ties go to the smaller id; repeated rows are
candidates each. Components and scores of any size are computed exactly; a score beyond 64 bits is given, and ranked, as the
nearest 64-bit number. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts_for

LEAF = 64
SHARD_BYTES = 3 << 20
BLOCK = 1024
#: Query blocks that one task takes.
BLOCKS_A_TASK = 16
SCALE = 256.0
#: Vectors that a coarse split is fitted on, its cells at most, and the boxes that are sent to the tasks at most.
SAMPLE = 4096
CELLS = 4096
BOX_BYTES = 32 << 20


class Tree:
    """A KD-tree over integer vectors, as flat arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.first, self.last, self.left, self.right = [], [], [], []
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            i, j, parent, side = todo.pop()
            at = len(self.first)
            if parent >= 0:
                (self.right if side else self.left)[parent] = at
            own = points[self.order[i:j]]
            lo, hi = own.min(0), own.max(0)
            low.append(lo)
            high.append(hi)
            self.first.append(i)
            self.last.append(j)
            self.left.append(-1)
            self.right.append(-1)
            if j - i > leaf and (hi > lo).any():
                d = int(np.argmax(hi - lo))
                m = (j - i) // 2
                self.order[i:j] = self.order[i:j][np.argpartition(own[:, d], m)]
                todo += [(i, i + m, at, 0), (i + m, j, at, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with anything in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: list[float]) -> list[list[tuple[int, int]]]:
    """For each query its best (score, id) of this tree, of those that reach its floor; at most k."""
    ids = ids[tree.order]
    bounds = tree.bounds(queries)
    out = []
    for q in range(len(queries)):
        bound, vec, own = bounds[q], queries[q], query_ids[q]
        if bound.dtype == object:
            bound = [_clamp(x) for x in bound]
        kth = floor[q]
        best: list[tuple[float, int]] = []  # a heap of (score, -id)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            i, j = tree.first[node], tree.last[node]
            score = tree.points[i:j] @ vec
            if score.dtype == object:
                score = np.array([_clamp(x) for x in score], object)
            for r in np.flatnonzero(score >= kth).tolist():
                if ids[i + r] == own:
                    continue
                item = (score[r], -int(ids[i + r]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        out.append([(int(s), -i) for s, i in sorted(best, reverse=True)])
    return out


def quantise(table: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, dim, vec): floor(scale * x) of valid vectors, as the bytes of doubles, which hold these integers exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            offs = np.asarray(col.offsets).astype(np.int64)
            flat = col.values.slice(offs[0], offs[-1] - offs[0])
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy()
            offs -= offs[0]
            bad = np.append(0, np.cumsum(~np.isfinite(x)))[offs]
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.floor(scale * x), -np.finfo(float).max, np.finfo(float).max)
            ok = np.asarray(col.is_valid()) & np.asarray(b.column("vec_id").is_valid()) & (np.diff(bad) == 0)
            at = np.flatnonzero(ok)
            vecs = pa.array([x[i:j].tobytes() for i, j in zip(offs[at], offs[at + 1], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array(np.diff(offs)[at].astype(np.int32)), vecs], names=["vec_id", "dim", "vec"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, vec binary")


def _matrix(col: pa.ChunkedArray | list[bytes], dim: int) -> np.ndarray:
    """Vectors as doubles if all their products are exact in doubles, else as Python integers."""
    raw = col if isinstance(col, list) else col.to_pylist()
    m = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
    top = float(np.abs(m).max(initial=0))
    if top * top * dim < 2.0**53:
        return m
    return _whole(m)


def _whole(m: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return m if m.dtype == object else np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _clamp(score) -> int:
    return min(max(int(score), _LEAST), _MOST)


@dataclass
class Split:
    """A coarse KD split of the vectors of one length: inner nodes as a heap of (dimension, value)."""

    dims: np.ndarray
    values: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, parts: int) -> Split:
        depth = max(0, math.ceil(math.log2(max(1, parts))))
        dims, values = np.zeros((1 << depth) - 1, np.int32), np.zeros((1 << depth) - 1)
        groups = [np.arange(len(sample))]
        for at in range(len(dims)):
            g = groups[at]
            if len(g) > 1:
                own = sample[g]
                dims[at] = int(np.argmax(own.max(0) - own.min(0)))
                values[at] = float(np.median(own[:, dims[at]]))
            low = sample[g, dims[at]] <= values[at] if len(g) else np.zeros(0, bool)
            groups += [g[low], g[~low]]
        return cls(dims, values)

    def place(self, vecs: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vecs), np.int64)
        while len(self.dims) and at[0] < len(self.dims):  # all are on one level
            at = 2 * at + 1 + (vecs[np.arange(len(vecs)), self.dims[at]] > self.values[at])
        return at - len(self.dims)


def _splits(vectors: DataFrame, shards: int) -> dict[int, Split]:
    """A split for each length of vectors, from a sample drawn by the hash of the id."""
    cells = min(shards, CELLS)
    sizes = {r[0]: r[1] for r in vectors.groupBy("dim").count().collect()}  # a row a length
    out = {}
    for dim, n in sizes.items():
        share = min(1.0, SAMPLE / n)
        rows = vectors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("vec").limit(2 * SAMPLE).collect()
        out[dim] = Split.fit(np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.float64).reshape(len(rows), dim), cells)
    return out


def _result(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})


def _reachable(boxes):
    """Each query once for every other shard whose box allows its kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, tuple] = {}
        for dim in {d for d, *_ in boxes.value}:
            mine = [x for x in boxes.value if x[0] == dim]
            low, high = (np.frombuffer(b"".join(x[k] for x in mine), np.float64).reshape(len(mine), dim) for k in (2, 3))
            by_dim[dim] = np.array([x[1] for x in mine]), low, high
        for b in batches:
            dims, raw, home = b.column("dim").to_pylist(), b.column("vec").to_pylist(), b.column("home").to_pylist()
            kth = b.column("kth").to_pylist()
            at, to = [], []
            for k, dim in enumerate(dims):
                shard, low, high = by_dim[dim]
                q = np.frombuffer(raw[k], np.float64)
                p, m = np.maximum(q, 0), np.minimum(q, 0)
                bound = high @ p + low @ m
                slack = 1e-9 * (np.abs(high) @ p - np.abs(low) @ m) + 1  # more than the rounding of large numbers
                far = ~(bound + slack < kth[k]) if kth[k] is not None else np.ones(len(shard), bool)  # not a number: overflow, so go
                go = shard[far & (shard != home[k])]
                at += [k] * len(go)
                to += go.tolist()
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to, pa.int32())], names=["query_id", "dim", "vec", "home", "kth", "block", "shard"])

    return run


def top_k(table: DataFrame, k: int = 5, every: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by every."""
    shards = parts_for(table, shard_bytes, 1)
    plain = materialise(quantise(table), "vectors")
    spark = plain.sparkSession
    splits = spark.sparkContext.broadcast(_splits(plain, shards))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raw = b.column("dim").to_numpy(), b.column("vec").to_pylist()
            cell = np.zeros(len(raw), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cell[at] = splits.value[dim].place(np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["vec_id", "dim", "vec", "cell"])

    placed = materialise(plain.mapInArrow(place, "vec_id long, dim int, vec binary, cell int"), "placed")
    # equal vectors are in one cell, however many; a cell of more than a shard is dealt to several
    base, parts = 0, []
    for dim, cell, n in sorted(tuple(r) for r in placed.groupBy("dim", "cell").count().collect()):  # a row a cell
        parts.append((dim, cell, base, max(1, -(-n * 8 * max(1, dim) // shard_bytes))))
        base += parts[-1][3]
    dealt = F.broadcast(spark.createDataFrame(parts, "dim int, cell int, base int, parts int"))
    shard = (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    vectors = placed.join(dealt, ["dim", "cell"]).select("vec_id", "dim", "vec", shard.alias("shard"))

    def home(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        ids, points = t.column("vec_id").to_numpy(), _matrix(t.column("vec"), dim)
        mine = np.flatnonzero(ids % every == 0)
        tree = Tree(points)
        got = search(tree, ids, points[mine], ids[mine], k, [-math.inf] * len(mine))
        raw = t.column("vec").take(pa.array(mine)).to_pylist()
        rows = [(int(ids[i]), dim, v, key[0].as_py(), [x[0] for x in g], [x[1] for x in g], None, None) for i, v, g in zip(mine, raw, got, strict=True)]
        box = [np.array([float(x) for x in edge]).tobytes() for edge in (tree.low[0], tree.high[0])]
        rows.append((None, dim, None, key[0].as_py(), None, None, *box))
        cols = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "dim", "vec", "home", "scores", "ids", "low", "high"), cols, types, strict=True)})

    started = materialise(vectors.groupBy("shard", "dim").applyInArrow(home, "query_id long, dim int, vec binary, home int, scores array<long>, ids array<long>, low binary, high binary"), "queries")
    boxes = started.where("query_id IS NULL")
    n_boxes, size = boxes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("low") * 2), F.lit(0))).first()
    started = started.where("query_id IS NOT NULL")
    n = started.count()
    blocks = max(1, -(-n // BLOCK))
    lots = max(1, -(-blocks // BLOCKS_A_TASK))
    kth = F.when(F.size("scores") >= k, F.element_at("scores", -1))
    asked = started.select("query_id", "dim", "vec", "home", kth.alias("kth"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    if size <= BOX_BYTES:
        sent_boxes = plain.sparkSession.sparkContext.broadcast([(r["dim"], r["home"], bytes(r["low"]), bytes(r["high"])) for r in boxes.select("dim", "home", "low", "high").collect()])
        away_from = asked.mapInArrow(_reachable(sent_boxes), "query_id long, dim int, vec binary, home int, kth long, block long, shard int")
    else:
        every_shard = boxes.select("dim", F.col("home").alias("shard"))
        away_from = asked.join(every_shard, "dim").where("shard <> home").select("query_id", "dim", "vec", "home", "kth", "block", "shard")
    sent = away_from.groupBy("dim", "shard", "block").agg(F.collect_list(F.struct("query_id", "vec", "home", "kth")).alias("q"))
    sent = sent.select("dim", "q", (F.col("block") % lots).cast("int").alias("lot"), "shard")
    stock = vectors.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

    def away(key: tuple, points: pa.Table, blocks_in: pa.Table) -> pa.Table:
        shard, dim = key[0].as_py(), key[1].as_py()
        if not points.num_rows or not blocks_in.num_rows:
            return _result([])
        ids, m = points.column("vec_id").to_numpy(), _matrix(points.column("vec"), dim)
        tree, rows = Tree(m), []
        for q in blocks_in.column("q").to_pylist():
            q = [x for x in q if x["home"] != shard]
            if not q:
                continue
            qs, walk = _matrix([x["vec"] for x in q], dim), tree
            if qs.dtype != m.dtype:  # one side holds numbers that doubles do not multiply exactly
                m, qs = _whole(m), _whole(qs)
                walk = tree = Tree(m)
            own = np.array([x["query_id"] for x in q], np.int64)
            floor = [-math.inf if x["kth"] is None else x["kth"] for x in q]
            for i, got in zip(own.tolist(), search(walk, ids, qs, own, k, floor), strict=True):
                rows += [(i, v, s) for s, v in got]
        return _result(rows)

    keys = ("shard", "dim", "lot")
    far = stock.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(away, "query_id long, vec_id long, score long")
    near = started.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = far.unionByName(near).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
