"""Best-fit packing of token sequences with a swap-based local search.

``pieces`` tokenises whole documents, ends each with id 0 and cuts those longer than a sequence. ``pack`` deals the pieces
evenly into small shards, whatever their ids. A shard packs its pieces best-fit decreasing and then runs the local search:
pieces move, or change places one for one or two for one, between underfull bins, always increasing the sum of squared
fills, until bins run empty. Full bins are done; all underfull bins of a shard travel on, in rows of at most ``PASS_ON``,
the emptiest first. About ``FAN_IN`` rows of like rank at a time are searched again, until one task holds all of them or a
level empties no bin, so no task ever holds more than a bounded number of bins.

A null or empty text is the single id 0. Repeated rows are packed each on its own; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, release_memory, tidy

CAPACITY = 2048
#: Pieces in a shard, about.
SHARD = 2000
#: Rows of underfull bins that are searched together, about.
FAN_IN = 32
END_ID = 0
#: Underfull bins in a row that travels on; all of them travel.
PASS_ON = 64

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"
PIECE_IDS_SCHEMA = PIECE_SCHEMA + ", ids binary"
PACKED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

# Below U+0250 (without U+0130) texts are in NFC and these classes are those of the tokenizer's pattern.
_PLAIN = re.compile("[^\x00-įı-ɏ]")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class _Ids(dict):
    """Words to the bytes of their ids; a missing word is taken from the older generation or encoded."""

    def __init__(self, model, old: dict):
        super().__init__()
        self.model, self.old = model, old

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            text = word if word.isascii() else word.encode("utf-8").decode("latin-1")
            got = np.array([t.id for t in self.model.tokenize(text.translate(_BYTE_LEVEL))], "<u4").tobytes()
        self[word] = got
        return got


#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Texts to little-endian 32-bit ids. The ids of words are kept, in two generations of bounded size."""

    KEEP = 150_000
    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known = _Ids(self.tok.model, {})

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One a process, so that later tasks find the words that earlier ones kept."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.KEEP:
            self.known.old = {}
            self.known = _Ids(self.tok.model, dict(self.known))
        find, get = _WORD.findall, self.known.__getitem__
        out: list[bytes] = []
        odd = []
        for i, t in enumerate(texts):
            if not t:
                out.append(b"")
            elif "<|" in t or not (t.isascii() or not _PLAIN.search(t)):
                out.append(b"")
                odd.append(i)
            else:
                out.append(b"".join(map(get, find(t.lower()))))
        if odd:
            for i, e in zip(odd, self.tok.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row a piece: its place in its document, length, crc32 of its ids, and an even number to deal it by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = Encoder.of(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        count = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        step = 4 * capacity
        for b in batches:
            text, ids = b.column("text"), b.column("doc_id").to_pylist()
            size = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
            for i, j in chunks(np.append(0, np.cumsum(size))):
                rows: list[tuple] = []
                for doc, seq in zip(ids[i:j], enc.encode(text.slice(i, j - i).to_pylist()), strict=True):
                    seq += end
                    for k, at in enumerate(range(0, len(seq), step)):
                        cut = seq[at : at + step]
                        rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut), count, cut))
                        count += 1
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "spread", "ids"]
                n = 7 if with_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)], names=names[:n])
            release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECE_IDS_SCHEMA if with_ids else PIECE_SCHEMA)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: bins of indices. An integer's bits tell which remainders have a bin."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            k = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
        r -= n
        free[r].append(k)
        mask |= 1 << r
    return bins


class _Bins:
    """Bins of pieces with, as long as they do not change, the sorted sums of what one exchange can take out of them."""

    def __init__(self, bins: list[list[int]], lengths: list[int]):
        self.items = [list(b) for b in bins]
        self.lengths = np.asarray(lengths, np.int64)
        self.fill = [int(self.lengths[b].sum()) for b in self.items]
        self._sums: dict[tuple[int, bool], tuple[np.ndarray, list[tuple[int, ...]]]] = {}
        self._bits: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, tuple[int, int]] = {}

    def sums(self, k: int, pairs: bool) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """Sums of one piece of bin k (of up to two, with pairs), ascending, and whose they are."""
        if (k, pairs) not in self._sums:
            of: dict[int, list[int]] = {}  # two pieces a length are enough; a bin has few different lengths
            for i in self.items[k]:
                same = of.setdefault(int(self.lengths[i]), [])
                if len(same) < 2:
                    same.append(i)
            sets: dict[int, tuple[int, ...]] = {}
            if pairs:
                for n, (x, a) in enumerate(of.items()):
                    if len(a) == 2:
                        sets[2 * x] = (a[0], a[1])
                    for y, b in islice(of.items(), n):
                        sets[x + y] = (a[0], b[0])
            sets.update((x, (a[0],)) for x, a in of.items())
            order = sorted(sets)
            self._sums[k, pairs] = np.array(order, np.int64), [sets[x] for x in order]
        return self._sums[k, pairs]

    def bits(self, k: int) -> tuple[int, int]:
        """The sums of bin k, without and with pairs, as the bits of two integers."""
        if k not in self._bits:
            one, two = (sum(1 << n for n in self.sums(k, pairs)[0].tolist()) for pairs in (False, True))
            self._bits[k] = one, two
        return self._bits[k]

    def can(self, giver: int, taker: int, room: int) -> bool:
        """Whether some exchange passes anything: a given sum exceeds one that comes back, or 0, by 1 up to the room."""
        if taker not in self._fits:
            fits = []
            for back in self.bits(taker)[::-1]:
                reach, n = back | 1, 1
                while n < room:  # OR of the first n shifts
                    d = min(n, room - n)
                    reach |= reach << d
                    n += d
                fits.append(reach << 1)
            self._fits[taker] = fits[0], fits[1]
        (one, two), (for_one, for_two) = self.bits(giver), self._fits[taker]
        return bool(one & for_one or two & for_two)

    def transfer(self, giver: int, taker: int, room: int) -> int:
        """The exchange that passes most, but no more than the room: one for none, one or two, two for none or one. What it passed."""
        best: tuple[int, tuple, tuple] = (0, (), ())
        for two_given in (False, True):
            give, given = self.sums(giver, two_given)
            back, taken = self.sums(taker, not two_given)
            back = np.append(0, back)
            at = np.searchsorted(back, give - room)
            ok = at < len(back)
            gain = np.where(ok, give - back[np.minimum(at, len(back) - 1)], 0)
            i = int(gain.argmax()) if len(gain) else -1
            if i >= 0 and gain[i] > best[0]:
                j = int(at[i])
                best = (int(gain[i]), given[i], taken[j - 1] if j else ())
        gain, given_items, taken_items = best
        if gain:
            for k, out, come, d in ((giver, given_items, taken_items, -gain), (taker, taken_items, given_items, gain)):
                self.items[k] = [x for x in self.items[k] if x not in out] + list(come)
                self.fill[k] += d
                self._sums.pop((k, False), None)
                self._sums.pop((k, True), None)
                self._bits.pop(k, None)
                self._fits.pop(k, None)
        return gain


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Empty the least filled bins into the others; each exchange goes to a fuller bin, so the sum of squared fills grows."""
    s = _Bins(bins, lengths)
    live = {k for k, f in enumerate(s.fill) if f}
    least = -(-sum(s.fill) // capacity)
    stuck: set[int] = set()
    while len(live) > least:
        takers = sorted((k for k in live if s.fill[k] < capacity), key=lambda k: (s.fill[k], k))
        donor = next((k for k in takers if k not in stuck), None)
        if donor is None:
            break
        others = [k for k in takers if k != donor and s.fill[k] >= s.fill[donor]]  # the emptiest first: they take most
        if sum(capacity - s.fill[k] for k in others) < s.fill[donor]:
            break
        before = None
        while s.fill[donor] not in (0, before):
            before = s.fill[donor]
            for k in others:
                while s.items[donor] and s.fill[k] < capacity and s.can(donor, k, capacity - s.fill[k]):
                    s.transfer(donor, k, capacity - s.fill[k])
                if not s.items[donor]:
                    break
        if s.items[donor]:
            stuck.add(donor)
        else:
            live.discard(donor)
    return [s.items[k] for k in sorted(live)]


_COLS = ("doc_id", "piece", "start", "length", "ids_crc32")
_KINDS = {"doc_id": np.int64, "piece": np.int32, "start": np.int64, "length": np.int64, "ids_crc32": np.int64}
_STATE_SCHEMA = PACKED_SCHEMA + ", shard long, rank int, bins long, rest binary"
_NULL = np.iinfo(np.int64).min


def _emit(cols: dict[str, np.ndarray], bins: list[list[int]], first_id: int, shard: int, last: bool, capacity: int) -> pa.Table:
    """Rows of the bins that are done (the full ones; all, if last), and rows that carry the others on, the emptiest first."""
    length = cols["length"]
    by_fill = sorted(bins, key=lambda b: int(length[b].sum()))
    open_bins = 0 if last else sum(int(length[b].sum()) < capacity for b in bins)
    done, rest = by_fill[open_bins:], by_fill[:open_bins]
    order = np.array([i for b in done for i in b], np.int64)
    seq = np.repeat(first_id + np.arange(len(done), dtype=np.int64), [len(b) for b in done])
    offset = np.concatenate([np.cumsum(length[b]) - length[b] for b in done]) if done else np.zeros(0, np.int64)
    out = {c: cols[c][order] for c in _COLS}
    left: list[bytes] = []
    held: list[int] = []
    i = 0
    while i < len(rest):
        j, n = i + 1, len(rest[i])
        while j < len(rest) and j - i < PASS_ON and n + len(rest[j]) <= SHARD:
            n += len(rest[j])
            j += 1
        r = np.array([x for b in rest[i:j] for x in b], np.int64)
        sizes = np.array([len(b) for b in rest[i:j]], np.int64)
        left.append(np.array([len(sizes), len(r)], np.int64).tobytes() + sizes.tobytes() + b"".join(cols[c][r].tobytes() for c in _COLS))
        held.append(len(sizes))
        i = j
    n = len(order)
    ids = pa.array(out["doc_id"], pa.int64(), mask=out["doc_id"] == _NULL)
    data = [ids, *(pa.array(out[c]) for c in _COLS[1:]), pa.array(seq), pa.array(offset, pa.int64())]
    data += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    names = [*_COLS, "sequence_id", "offset", "shard", "rank", "bins", "rest"]
    t = pa.table(dict(zip(names, data, strict=True)))
    if left:
        m = len(left)
        more = {c: pa.nulls(m, t.schema.field(c).type) for c in names}
        more |= {"shard": pa.array([shard] * m, pa.int64()), "rank": pa.array(range(m), pa.int32()), "bins": pa.array(held, pa.int64()), "rest": pa.array(left, pa.binary())}
        t = pa.concat_tables([t, pa.table(more)])
    return t


def _load(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    parts: dict[str, list] = {c: [] for c in _COLS}
    bins: list[list[int]] = []
    at = 0
    for raw in blobs:
        n_bins, n = np.frombuffer(raw, np.int64, 2).tolist()
        sizes = np.frombuffer(raw, np.int64, n_bins, 16).tolist()
        pos = 16 + 8 * n_bins
        for c in _COLS:
            parts[c].append(np.frombuffer(raw, _KINDS[c], n, pos))
            pos += n * np.dtype(_KINDS[c]).itemsize
        for s in sizes:
            bins.append(list(range(at, at + s)))
            at += s
    return {c: np.concatenate(x) for c, x in parts.items()}, bins


def _again(base: int, last: bool, capacity: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        raw = [x[-1] for x in sorted(zip(*(t.column(c).to_pylist() for c in ("shard", "rank", "rest")), strict=True))]
        cols, bins = _load(raw)
        return _emit(cols, local_search(bins, cols["length"].tolist(), capacity), base | (k << 20), k, last, capacity)

    return tidy(run)


def _regroup(state: DataFrame, ranks: list, rows: int, level: int) -> DataFrame:
    """The rows that travel on, with the group that searches each: rows of neighbouring ranks, about FAN_IN together."""
    rest = state.where(F.col("rest").isNotNull()).select("shard", "rank", "rest")
    to, base, i = F.lit(0).cast("long"), 0, 0
    while rows > FAN_IN and i < len(ranks):
        j, n = i + 1, ranks[i][1]
        while j < len(ranks) and n + ranks[j][1] <= FAN_IN:
            n += ranks[j][1]
            j += 1
        groups = -(-n // FAN_IN)
        to = F.when(F.col("rank") >= ranks[i][0], base + F.pmod(F.xxhash64("shard", F.lit(level)), F.lit(groups))).otherwise(to)
        base, i = base + groups, j
    return rest.withColumn("to", to)


def pack(table: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Pieces(doc_id, piece, start, length, ids_crc32, spread) with the sequence and the offset that each got."""
    n = table.count()
    shards = max(1, -(-n // shard))

    def first(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        cols = {c: np.asarray(pc.fill_null(t.column(c), _NULL) if c == "doc_id" else t.column(c)).astype(_KINDS[c]) for c in _COLS}
        lengths = cols["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        return _emit(cols, bins, k << 20, k, shards == 1, capacity)

    dealt = table.withColumn("shard", F.pmod(F.xxhash64("spread"), F.lit(shards)))
    state = materialise(dealt.groupBy("shard").applyInArrow(tidy(first), _STATE_SCHEMA), "packed")
    out = state.where(F.col("rest").isNull())
    level, before = 0, None
    while True:
        closed = state.where(F.col("offset") == 0).count() if before is not None else 0
        ranks = state.where(F.col("rest").isNotNull()).groupBy("rank").agg(F.count(F.lit(1)), F.sum("bins")).orderBy("rank").collect()
        if not ranks:
            break
        rows, left = sum(r[1] for r in ranks), sum(r[2] for r in ranks)
        last = rows <= FAN_IN or (before is not None and closed + left == before)  # one task, or no bin was emptied
        level, before = level + 1, left
        state = materialise(_regroup(state, ranks, rows, level).groupBy("to").applyInArrow(_again(level << 56, last, capacity), _STATE_SCHEMA), "packed")
        out = out.unionByName(state.where(F.col("rest").isNull()))
        if last:
            break
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
