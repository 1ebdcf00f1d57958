"""SimHash near-duplicates by multi-index hashing.

``near_duplicates`` links fingerprints: ``fingerprints`` makes a 64-bit SimHash of each whole text, and ``link`` finds all
that differ in at most ``DISTANCE`` bits. The 64 bits are cut into segments with a radius each, so that two such fingerprints
must agree within the radius on one segment (the sum of radius + 1 exceeds the distance). A fingerprint is put into the tables
of its segment values and of all values with up to radius more bits set - two values that differ in so few bits meet at the
union of their bits - and what is fetched is verified on all 64 bits. Wider segments are used for more fingerprints, and the
number of buckets follows theirs, so neither a table entry nor a task grows with the corpus. Equal fingerprints are one entry.

``similar_rows`` finds texts whose sets of ``WORDS``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more, all of them,
by prefix filtering. All shingles have one order, those that a sample found in many texts last; two sets of n shingles or fewer that
are so similar share one of the first n - ceil(similarity * n) + 1 of each. Each distinct set is put under these first shingles.
Where up to ``SMALL`` sets meet, all pairs that their sizes and the shingle's places in them allow are candidates; where more meet, all.
What candidates connect is a block, in which each set stands once, however many shingles it shares. A block is searched for its links
whole: a bitmap of each set bounds the difference of two from below, and what it lets through is verified on the whole sets. In blocks of
more than ``BLOCK`` sets the pairs of the small meetings are verified one by one, and what the large ones alone connect is searched two
parts at a time, every two parts. The order and the sample decide on the time only, never on the result.

Links that meet are joined by alternating star contractions; only counts reach the driver.

Null and empty texts have fingerprint zero and an empty set of shingles; two empty sets are equal. A text of fewer words than a
shingle is one shingle. Rows with a null doc_id are linked as any others, but give no component its id: a component of such rows
only has a null id. Repeated rows and rows that share an id are handled each. Whole texts are hashed, a block of shingles at a
time. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_TABLE, free_name, materialise, mix, only_few, release_memory, tidy

SHINGLE = 4
DISTANCE = 4
#: (first bit, bits, radius of the ball): for up to 2 ** 23 fingerprints, and for more.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
WIDE_SEGMENTS = ((0, 32, 2), (32, 32, 1))
#: Groups up to this size are compared in all pairs; larger ones by their leaders (fingerprints) or in blocks (sets of shingles).
SMALL = 48
SEED = 42
#: Fingerprints whose table entries are dealt to the buckets together, and entries for each bucket.
DEAL_ROWS = 1 << 13
BUCKET_ENTRIES = 1 << 21

WORDS = 5
SIMILARITY = 0.8
#: Share of the pairs of the least similarity that may meet in no table of a ``segment_plan``.
MISS = 0.01
#: For the order of shingles: one text in so many is counted, at most, and of SAMPLE_TEXTS texts or fewer each; the shingles that
#: are in so many of these are frequent, and so many of the most frequent are kept.
SAMPLE_EVERY, SAMPLE_TEXTS, FREQUENT, MOST_FREQUENT = 16, 1 << 14, 3, 1 << 18
#: Bytes of first shingles that are dealt to the buckets together, and entries for each bucket.
DEAL_BYTES = 1 << 22
PREFIX_ENTRIES = 1 << 19
#: Sets of a block that one task compares (of two parts, each half), and sets of small blocks for each task.
BLOCK, BLOCK_DEAL = 1 << 14, 1 << 12


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles of a text, repeats included."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    flat = b" ".join(ws)
    if len(ws) <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(flat[s:e], SEED) for s, e in zip(starts[: len(ws) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits that are set in over half of the hashes, as 64-bit words; further words come from remixed hashes."""
    out = np.zeros(words, np.uint64)
    if not len(h):
        return out
    counts = np.zeros(64 * words, np.int64)
    salt = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = max(1, (1 << 14) // words)
    for i in range(0, len(h), step):
        x = h[i : i + step, None]
        x = np.concatenate([x, mix(x + salt[1:])], axis=1) if words > 1 else x
        counts += np.add.reduce(np.unpackbits(x.astype(">u8").view(np.uint8), axis=1), axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(h)).view(">u8").astype(np.uint64)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text: bits that are set in over half of the shingles' XXH64."""
    return int(majority(shingle_hashes(text, shingle))[0])


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("text")
            fps = np.fromiter((simhash(_bytes(x), shingle) for x in col), np.uint64, len(col))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
            release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def ball(v: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, index): each value and those with up to radius more bits set. Values that differ in so many bits share one."""
    values, who, last = [v], [np.arange(len(v))], [np.full(len(v), -1)]
    for _ in range(radius):
        v, at, top = values[-1], who[-1], last[-1]
        more = []
        for b in range(bits):  # bits are added in ascending order, so that each set is made once
            clear = np.flatnonzero(((v >> np.uint64(b)) & np.uint64(1) == 0) & (top < b))
            more.append((v[clear] | np.uint64(1 << b), at[clear], np.full(len(clear), b)))
        for held, x in zip((values, who, last), zip(*more, strict=True), strict=True):
            held.append(np.concatenate(x))
    return np.concatenate(values), np.concatenate(who)


def table_entries(fps: np.ndarray, segments=SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) for every segment's ball; fps: one 64-bit word each, or several in columns."""
    wide = fps.reshape(len(fps), -1)
    keys, who = [], []
    for s, (low, bits, radius) in enumerate(segments):
        word, shift = divmod(low, 64)
        v = wide[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (wide[:, word + 1] << np.uint64(64 - shift))
        value, at = ball(v & np.uint64((1 << bits) - 1), bits, radius)
        keys.append(value | np.uint64(s << 40))
        who.append(at)
    return np.concatenate(keys), np.concatenate(who)


def forest(key: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, node) that connect, among entries of an equal key, whatever lies within the distance."""
    order = np.argsort(key, kind="stable")
    key, fp, node = key[order], fp[order], node[order]
    a, b, first, size = _small_groups(key, fp, node, distance)
    for i, m in zip(first.tolist(), size.tolist(), strict=True):
        f, v = fp[i : i + m], node[i : i + m]
        f, u = np.unique(f, return_index=True)
        v = v[u]
        left = np.arange(len(f))
        queue: list[int] = []
        while len(left) or queue:
            if not queue:
                queue, left = [int(left[0])], left[1:]
            cur = queue.pop()
            near = np.bitwise_count(f[left] ^ f[cur]) <= distance
            if near.any():
                got = left[near]
                left = left[~near]
                a.append(np.full(len(got), v[cur]))
                b.append(v[got])
                queue += got.tolist()
    return _pairs(a, b)


def _small_groups(key, fp, node, distance) -> tuple[list, list, np.ndarray, np.ndarray]:
    """All pairs within the distance in groups of up to SMALL entries of a key (sorted); first places and sizes of the others."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    a, b = [], []
    small = np.repeat((size > 1) & (size <= SMALL), size)
    k2, f2, n2 = key[small], fp[small], node[small]
    for shift in range(1, int(min(SMALL, size.max(initial=1)))):
        near = np.flatnonzero((k2[shift:] == k2[:-shift]) & (n2[shift:] != n2[:-shift]))
        near = near[np.bitwise_count(f2[near + shift] ^ f2[near]) <= distance]
        a.append(n2[near])
        b.append(n2[near + shift])
    return a, b, first[size > SMALL], size[size > SMALL]


def _pairs(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller node first."""
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pair[:, 0], pair[:, 1]


def _dealt(key: np.ndarray, fp: np.ndarray, node: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Table entries, packed: a row for each bucket."""
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    ids, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(bucket))
    blobs = [[x[i:j].tobytes() for i, j in zip(first, ends, strict=True)] for x in (key[order], fp[order], node[order])]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "keys", "fps", "nodes"])


def _deal(reps: DataFrame, entries, full) -> DataFrame:
    """The packed table entries of reps: of as many batches together as are full."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if full(held):
                yield entries(held)
                held = []
                release_memory()
        if held:
            yield entries(held)

    return reps.mapInArrow(spread, "bucket int, keys binary, fps binary, nodes binary")


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    return join("keys", np.uint64), join("fps", np.uint64), join("nodes", np.int64)


def link(reps: DataFrame, buckets: int, distance: int = DISTANCE, segments=SEGMENTS) -> DataFrame:
    """reps(node, fp), fp distinct: edges (a, b) between nodes whose components are those of all links."""
    if sum(1 + radius for _, _, radius in segments) <= distance:
        raise ValueError("the segments are too few for this distance")

    def meet(t: pa.Table) -> pa.Table:
        a, b = forest(*_unpacked(t), distance)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def entries(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, fp = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("node", "fp"))
        key, who = table_entries(fp.view(np.uint64), segments)
        return _dealt(key, fp[who], node[who], buckets)

    dealt = _deal(reps.select("node", "fp"), entries, lambda held: sum(b.num_rows for b in held) >= DEAL_ROWS)
    return dealt.groupBy("bucket").applyInArrow(tidy(meet), "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node that is reachable, for every node that has an edge.

    Alternating large-star and small-star steps; each round is written to the shared folder and only counts reach the driver."""
    e = materialise(edges.select("a", "b").where("a <> b").distinct(), "links")
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now each edge leads from u to a smaller v
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").where("x <> m").union(down.select(F.col("u").alias("x"), "m"))
        e = materialise(small.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct(), "links")
        # settled once all edges lead straight to a root: no node has two edges down, or one down and one up
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("down").alias("d"), F.max("up").alias("u")).where("d > 1 OR (d = 1 AND u = 1)").head(1):
            break
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")


def _buckets(n: int, segments) -> int:
    """Buckets for n fingerprints: about half of a segment's bits are clear."""
    each = sum(sum(math.comb(-(-bits // 2), r) for r in range(radius + 1)) for _, bits, radius in segments)
    return max(8, -(-n * each // BUCKET_ENTRIES))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments=None, buckets: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that is reachable over links of fingerprints."""
    fps = materialise(fingerprints(docs, shingle), "simhash")
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    n = reps.count()
    segments = segments or (SEGMENTS if n <= 1 << 23 else WIDE_SEGMENTS)
    labels = components(link(reps.select(F.col("fp").alias("node"), "fp"), buckets or _buckets(n, segments), distance, segments))
    of = reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    of = materialise(of, "components")
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialise(of.join(names, "root").select("fp", "component_id"), "components")  # a plain table, so that the join can split a fingerprint that many documents share
    return fps.join(of, "fp", "left").select("doc_id", "fp", "component_id")


# --- similar sets of shingles


def segment_plan(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[tuple[int, int, int], ...]:
    """Segments of radius 1 over bits from 64 on, for n texts: wide enough that a table has a few entries a key, and so
    many that texts of the similarity share a table but for the given share."""
    bits = min(32, max(14, math.ceil(math.log2(max(n, 2))) + 1))
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of each bit
    meet = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
    return tuple((64 + k * bits, bits, 1) for k in range(math.ceil(math.log(miss) / math.log(1 - meet))))


def _frequent(rows: DataFrame, row: str, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of shingles that many texts of a sample have, sorted, and the rank of each by frequency (1: the rarest)."""
    every = min(SAMPLE_EVERY, max(1, n // SAMPLE_TEXTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(_bytes(x), shingle)).view(np.int64))], names=["h"])
            release_memory()

    sample = rows.where(F.pmod(F.xxhash64(row), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, count = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, count))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def prefix(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a sorted set of hashes the first ones in the common order: one of them is in every set that is similar enough."""
    size = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
    known, rank = frequent
    if not len(known):
        return h[:size]
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return h[np.argsort(np.where(known[at] == h, rank[at], 0), kind="stable")[:size]]


def _sketches(rows: DataFrame, row: str, frequent: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """(node, n, c1, c2, prefix) of each row: the size and a 128-bit digest of its shingle set, and its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("text"):
                h = np.unique(shingle_hashes(_bytes(x), shingle))
                c1, c2 = (int(mix(h + np.uint64(s)).sum(dtype=np.uint64).view(np.int64)) for s in (1, 2))
                out.append((len(h), c1, c2, prefix(h, frequent, similarity).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(row), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["node", "n", "c1", "c2", "prefix"])
            release_memory()

    return rows.select(row, "text").mapInArrow(run, "node long, n int, c1 long, c2 long, prefix binary")


def _prefix_entries(buckets: int):
    """Packed entries of sets under their first shingles, each with the shingle's place in the set and the set's size."""

    def entries(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, n = (np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in ("node", "n"))
        parts = [np.frombuffer(x, np.uint64) for b in held for x in b.column("prefix").to_pylist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return _dealt(np.concatenate(parts), place << 32 | np.repeat(n, size), np.repeat(node, size), buckets)

    return entries


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least node reachable over the edges, node) for every node but these least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            break
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    low = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[up[low]], nodes[low]


def _meetings(key: np.ndarray, place_size: np.ndarray, node: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries of an equal key: in small groups the pairs that can be similar enough, and large groups as a forest (a, b, a, b).

    At the first shingle that two sets share, at most that one and the later ones of both are common."""
    order = np.lexsort((node, key))
    key, place_size, node = key[order], place_size[order], node[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    small = np.repeat((size > 1) & (size <= SMALL), size)
    k, v = key[small], node[small]
    n = (place_size[small] & 0xFFFFFFFF).astype(np.int64)
    rest = n - (place_size[small] >> 32).astype(np.int64)
    a, b = [], []
    for shift in range(1, int(min(SMALL, size.max(initial=1)))):
        i = np.flatnonzero(k[shift:] == k[:-shift])
        j = i + shift
        can = np.minimum(rest[i], rest[j]) * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6
        a.append(v[i[can]])
        b.append(v[j[can]])
    large = np.flatnonzero(np.repeat(size > SMALL, size))
    lead = np.repeat(first, size)[large]
    return *_pairs(a, b), *star_forest(node[lead], node[large])


def _sets(rows: DataFrame, row: str, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the shingle sets of those row numbers, sorted without sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(_bytes(x), shingle)).view(np.int64) for x in b.column("text")]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            offs = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([b.column(row), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat))], names=["node", "s"])
            release_memory()

    nodes = only_few(nodes.select(F.col("node").alias(row)).distinct(), "asked")
    return materialise(rows.select(row, "text").join(nodes, row, "left_semi").select(row, "text").mapInArrow(run, "node long, s array<long>"), "shingle-sets")


def _verified(pairs: DataFrame, rows: DataFrame, row: str, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of row numbers whose shingle sets are similar enough."""
    pairs = materialise(pairs.distinct(), "candidates")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = _sets(rows, row, nodes, shingle)
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    met = pairs.join(a, "a").join(b, "b")
    least = similarity - 1e-12  # for what rounds to just above it
    met = met.where(F.least(F.size("sa"), F.size("sb")) >= least * F.greatest(F.size("sa"), F.size("sb")))
    common = F.size(F.array_intersect("sa", "sb"))
    return materialise(met.where(common >= least * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "similar")


def similar_forest(flat: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (numbers of sets) that connect whatever is similar enough; flat: the sorted sets, one after another.

    A set's bitmap tells for each of its bits whether an odd number of its hashes falls there, so the bitmaps of two sets differ in
    no more bits than the sets do in hashes."""
    m = len(size)
    order = np.argsort(size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    n = size[order]
    bits = 64 << min(6, max(2, int(np.median(n) * 4).bit_length() - 6)) if m else 64
    maps = np.empty((m, bits // 64), np.uint64)
    for i in range(m):
        odd = np.bincount((mix(flat[start[i] : start[i] + n[i]]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        maps[i] = np.packbits(odd.astype(bool)).view(np.uint64)
    least = similarity - 1e-12
    a, b = [], []
    left, queue = np.arange(m), []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        cur = queue.pop()
        mine = flat[start[cur] : start[cur] + n[cur]]
        lo, hi = np.searchsorted(n[left], [least * n[cur], n[cur] / least + 1])
        some = left[lo:hi]
        differ = np.bitwise_count(maps[some] ^ maps[cur]).sum(1, dtype=np.int64)
        can = np.flatnonzero(differ * (1 + similarity) <= (1 - similarity) * (n[some] + n[cur]) + 1e-6)
        for i in range(0, len(can), 512):
            part = can[i : i + 512]
            to = some[part]
            at = np.arange(int(n[to].sum())) + np.repeat(start[to] - (np.cumsum(n[to]) - n[to]), n[to])
            theirs = flat[at]
            has = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            common = np.add.reduceat(has, np.cumsum(n[to]) - n[to], dtype=np.int64)
            near = common >= least * (n[to] + n[cur] - common)
            can[i : i + 512] = np.where(near, part, -1)
        got = can[can >= 0]
        if len(got):
            a.append(np.full(len(got), order[cur]))
            b.append(order[some[got]])
            queue += some[got].tolist()
            left = np.delete(left, lo + got)
    return _pairs(a, b)


def _block_links(blocks: DataFrame, rows: DataFrame, row: str, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect whatever is similar enough within a block; blocks: (node, block, n), n: the block's sets.

    A task takes some blocks, or two parts of one that is too large, each set with its text's shingles once."""
    parts = F.when(F.col("n") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / F.lit(BLOCK)).cast("int"))
    dealt = blocks.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part OR parts = 1")
    tasks = max(8, -(-blocks.count() // BLOCK_DEAL))
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("block"), F.lit(tasks))).otherwise(-1 - F.col("block"))
    dealt = dealt.select("node", "block", task.alias("task"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def search(t: pa.Table) -> pa.Table:
        node, block, sets = t.column("node").to_numpy(), t.column("block").to_numpy(), t.column("s").combine_chunks()
        flat, size = sets.flatten().to_numpy().view(np.uint64), np.diff(sets.offsets.to_numpy()).astype(np.int64)
        start = np.cumsum(size) - size
        order = np.argsort(block, kind="stable")
        a, b = [], []
        for of in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            x, y = similar_forest(np.concatenate([flat[start[k] : start[k] + size[k]] for k in of.tolist()]), size[of], similarity)
            a.append(node[of[x]])
            b.append(node[of[y]])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    sets = _sets(rows, row, blocks.select("node"), shingle)
    dealt = materialise(dealt, "dealt")  # a set of a large block is asked for once for each other part
    found = sets.join(F.broadcast(dealt) if dealt.count() <= SMALL_TABLE else dealt.hint("merge"), "node").select("task", "i", "j", "block", "node", "s")
    return materialise(found.groupBy("task", "i", "j").applyInArrow(tidy(search), "a long, b long"), "similar")


def _blocks(edges: DataFrame) -> DataFrame:
    """(node, block, n): the components of the edges and their sizes."""
    inner = components(edges).select("node", F.col("component").alias("block"))
    of = inner.union(inner.select("block", "block").distinct())
    sizes = inner.groupBy("block").agg((F.count("*") + 1).alias("n"))
    return materialise(of.join(sizes, "block").select("node", "block", "n"), "blocks")


def similar_rows(rows: DataFrame, row: str, shingle: int = WORDS, similarity: float = SIMILARITY, buckets: int | None = None) -> DataFrame:
    """(row, group): for every row number the least row number of the texts that are reachable over similar ones."""
    found = materialise(_sketches(rows, row, _frequent(rows, row, rows.count(), shingle), shingle, similarity), "sketches")
    same = materialise(found.groupBy("n", "c1", "c2").agg(F.min("node").alias("least")), "same")
    copies = materialise(found.join(same, ["n", "c1", "c2"]).where("node <> least").select("node"), "copies")
    if not buckets:
        buckets = max(8, -(-(found.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // (8 * PREFIX_ENTRIES)))

    def meet(t: pa.Table) -> pa.Table:
        key, place_size, node = _unpacked(t)
        a, b, c, d = _meetings(key, place_size, node, similarity)
        large = np.arange(len(a) + len(c)) >= len(a)
        return pa.table({"a": pa.array(np.append(a, c), pa.int64()), "b": pa.array(np.append(b, d), pa.int64()), "large": pa.array(large)})

    reps = found.where("n > 0").select("node", "n", "prefix").join(copies, "node", "left_anti")
    dealt = _deal(reps, _prefix_entries(buckets), lambda held: sum(b.nbytes for b in held) >= DEAL_BYTES)
    met = materialise(dealt.groupBy("bucket").applyInArrow(tidy(meet), "a long, b long, large boolean").distinct(), "met")
    blocks = _blocks(met)
    links = _block_links(blocks.where(F.col("n") <= BLOCK), rows, row, shingle, similarity)
    wide = blocks.where(F.col("n") > BLOCK)
    if wide.head(1):  # too many sets for a task: pair by pair where few meet, else only where many meet
        rest = met.join(wide.select(F.col("node").alias("a")), "a", "left_semi")
        links = links.union(_verified(rest.where("NOT large").select("a", "b"), rows, row, shingle, similarity))
        links = links.union(_block_links(_blocks(rest.where("large").select("a", "b")), rows, row, shingle, similarity))
    labels = materialise(components(links), "labels")
    of = same.join(labels, same["least"] == labels["node"], "left").select("n", "c1", "c2", F.coalesce("component", "least").alias("group"))
    of = materialise(of, "labels")
    return found.join(of, ["n", "c1", "c2"]).select(F.col("node").alias(free_name([], "row")), "group")
