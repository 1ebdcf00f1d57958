"""Duplicate byte strings by run-compressed Burrows-Wheeler indexes.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id. The corpus
is cut into lots (see ``lots``). Texts that share such a string share its minimizer, the least hash of its ``SEED`` byte
strings, so strings are dealt to buckets by minimizer:

1. every lot sends its distinct minimizers, and learns which of them stand in other documents too;
2. for those, a lot sends the stretches of text that they cover to the minimizer's bucket. A bucket concatenates its
   distinct stretches, sorts their suffixes and keeps the index (``RunIndex``): the run-length encoded transform with the number of
   each run's byte before it, text positions sampled at the ends of the runs, the rank of each stretch's end, and the thresholds
   between suffixes that agree in fewer than ``LENGTH`` bytes, each with the rank of its string in the first document. The suffix array
   is dropped. The stretches are then streamed from right to left: each step is an LF step over the runs, the threshold gives the
   first document's suffix, the nearest sample its position, and the statistic of a place is that position and how far the match
   goes on. Matches of ``LENGTH`` bytes and more are sent back to the lots as runs;
3. every lot marks the bytes of matches whose source is a smaller id.

Some buckets travel as one group, a row for each lot, and are indexed one by one. Identical stretches are indexed once a bucket with their smallest document, so thousands of copies cost a lot each, not
a pair each; a stretch of one repeated minimizer is cut into parts of ``PART`` strings, so a long run of one byte is a few equal
stretches. Matches never cross documents. Rows with a null id keep all bytes and are no source; rows that share an id are no
source for each other; null texts are empty. Very long texts are a lot of their own. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, input_bytes, materialise, mix, release_memory, span_hashes, tidy
from .lots import Lot, by_bucket, pack, squeeze, store, table_of, unpack, unsqueeze

LENGTH = 50
SEED = 24
#: Strings of one minimizer in a stretch at most.
PART = 256
#: Bits of a minimizer's hash that travel; a collision only sends text that turns out to be unique.
HASH_BITS = 48
#: Input bytes for each bucket.
BUCKET_BYTES = 1 << 20
#: Buckets that travel together at most, and groups of them that are made before a group gets more than one: a row for every lot and
#: group is sent, so this keeps the rows' own cost, which grows with the square of the input, small.
GROUP, GROUPS = 16, 64
#: Bytes of a lot, and bytes that one kernel call hashes.
LOT_BYTES = 4 << 20
STEP = 1 << 19

ASK = [("bucket", pa.int32()), ("lot", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())]
ASK_SCHEMA = "bucket int, lot long, keys binary, many binary"
TEXT = [("bucket", pa.int32()), ("lot", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())]
TEXT_SCHEMA = "bucket int, lot long, docs binary, sizes binary, data binary"
ANSWER = [("kind", pa.int32()), ("lot", pa.int64()), ("bucket", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("third", pa.binary())]
ANSWER_SCHEMA = "kind int, lot long, bucket int, first binary, second binary, third binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>"


def _string_sums(data: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def minimizers(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """For each place at which a string of the length starts, the least hash of its seed strings."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = _string_sums(data)
    h = mix((c[seed:] - c[:-seed]) * _powers(len(data) + 1)[1][: len(data) - seed + 1]) >> np.uint64(64 - HASH_BITS)
    w, m, span = length - seed + 1, h, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    return m[:n]


@dataclass
class Stretches:
    """Maximal runs of a lot's strings with one minimizer: hash, document, first byte, number of strings."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, lot: Lot, length: int = LENGTH) -> Stretches:
        # where no string starts: at the last places of each document, and anywhere in one without an id
        bad_from = np.where(lot.null_ids, lot.offs[:-1], np.maximum(lot.offs[:-1], lot.offs[1:] - length + 1))
        bad_to = lot.offs[1:]
        some = bad_to > bad_from
        step = np.zeros(len(lot.data) + 1, np.int8)
        step[bad_from[some]] += 1
        step[bad_to[some]] -= 1
        bad_all = np.cumsum(step[:-1], dtype=np.int8) > 0
        parts: list[tuple] = []
        for a in range(0, max(0, len(lot.data) - length + 1), STEP):
            m = minimizers(lot.data[a : a + STEP + length - 1], length)
            bad = bad_all[a : a + len(m)]
            edge = np.ones(len(m), bool)
            edge[1:] = m[1:] != m[:-1]
            edge[1:] |= bad[1:] | bad[:-1]
            at = np.flatnonzero(edge)
            size = np.diff(np.append(at, len(m)))
            good = ~bad[at]
            first, size = at[good], size[good]
            parts_of = -(-size // PART)  # long stretches are cut
            which = np.repeat(np.arange(len(first)), parts_of)
            off = (np.arange(len(which)) - np.repeat(np.cumsum(parts_of) - parts_of, parts_of)) * PART
            first, size = first[which] + off, np.minimum(PART, size[which] - off)
            # least hashes are small numbers, so they are mixed again before they are dealt out by their first bits
            parts.append((mix(m[first]) >> np.uint64(64 - HASH_BITS), np.searchsorted(lot.offs, first + a, side="right") - 1, first + a, size))
        if not parts:
            z = np.zeros(0, np.int64)
            return cls(np.zeros(0, np.uint64), z, z, z)
        return cls(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(HASH_BITS - 24)) * np.uint64(buckets)) >> np.uint64(24)


def grouping(buckets: int) -> tuple[int, int]:
    """(buckets of a group, groups)."""
    each = min(GROUP, max(1, buckets // GROUPS))
    return each, -(-buckets // each)


def _distinct(lot: Lot, s: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lot's minimizers, sorted; whether more than one document of the lot has each; and which of them each stretch has."""
    order = np.argsort(s.hash, kind="stable")
    h, ids = s.hash[order], lot.ids[s.doc[order]]
    if not len(h):
        return h, np.zeros(0, bool), order
    new = np.append(True, h[1:] != h[:-1])
    first = np.flatnonzero(new)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return h[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), which


def _ask(buckets: int, length: int):
    each, groups = grouping(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lot = Lot(row)
                keys, many, _ = _distinct(lot, Stretches.of(lot, length))
                group = _bucket(keys, buckets) // np.uint64(each)  # grows with the key
                rows = [(k, row["lot"], pack(np.diff(keys[s], prepend=np.uint64(0))), squeeze(np.packbits(many[s]).tobytes())) for k, s in by_bucket(group, groups)]
                yield from table_of(rows, ASK).to_batches()
                release_memory()

    return run


def _shared(t: pa.Table) -> pa.Table:
    """To each lot a bit for each minimizer that it sent: whether another document has it too."""
    lots, bucket = t.column("lot").to_pylist(), t.column("bucket")[0].as_py()
    keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()]
    many = [np.unpackbits(np.frombuffer(unsqueeze(x), np.uint8), count=len(k)) for x, k in zip(t.column("many").to_pylist(), keys, strict=True)]
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(which, minlength=len(every)) + np.bincount(which, weights=np.concatenate(many), minlength=len(every)) > 1
    rows, at = [], 0
    for lot, k in zip(lots, keys, strict=True):
        rows.append((1, lot, bucket, squeeze(np.packbits(shared[which[at : at + len(k)]]).tobytes()), None, None))
        at += len(k)
    return table_of(rows, ANSWER)


@dataclass
class Sent:
    """What a lot sends: its distinct stretches with shared minimizers, by bucket; and for each stretch, which of these it is."""

    stretches: Stretches
    which: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, lot: Lot, answers: pa.Table, buckets: int, length: int) -> Sent:
        s = Stretches.of(lot, length)
        keys, _, of = _distinct(lot, s)
        each, groups = grouping(buckets)
        cut = np.searchsorted(_bucket(keys, buckets) // np.uint64(each), np.arange(groups + 1))
        shared = np.zeros(len(keys), bool)
        for r in answers.select(["kind", "bucket", "first"]).to_pylist():
            if r["kind"] == 1:
                a, b = cut[r["bucket"]], cut[r["bucket"] + 1]
                shared[a:b] = np.unpackbits(np.frombuffer(unsqueeze(r["first"]), np.uint8), count=int(b - a))
        keep = np.flatnonzero(shared[of]) if len(keys) else np.zeros(0, np.int64)
        s = Stretches(s.hash[keep], s.doc[keep], s.start[keep], s.count[keep])
        content = span_hashes(lot.data, s.start, s.count + length - 1)
        order = np.lexsort((lot.ids[s.doc], content, _bucket(s.hash, buckets)))
        c = content[order]
        new = np.append(True, c[1:] != c[:-1]) if len(c) else np.zeros(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        return cls(s, which, first, lot.ids[s.doc[first]], _bucket(s.hash[first], buckets).astype(np.int64))


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given parts, one after another."""
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return data[at]


def _send(buckets: int, length: int):
    def run(key: tuple, lots: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in lots.to_pylist():
            lot = Lot(row)
            s = Sent.of(lot, answers, buckets, length)
            size = s.stretches.count[s.first] + length - 1
            each, groups = grouping(buckets)
            for k, sl in by_bucket(s.bucket // each, groups):
                data = gather(lot.data, s.stretches.start[s.first[sl]], size[sl])
                count = np.bincount(s.bucket[sl] - k * each, minlength=each)
                rows.append((k, row["lot"], pack(np.concatenate([count, s.doc[sl]])), pack(size[sl]), squeeze(data.tobytes())))
        return table_of(rows, TEXT)

    return tidy(run)


class Marks:
    """Marked ranks as a bit vector with counts: which mark is the last one up to a rank."""

    def __init__(self, marked: np.ndarray, n: int):
        bits = np.zeros((n // 64 + 1) * 64, bool)
        bits[marked] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)) - 1

    def last(self, rank: np.ndarray) -> np.ndarray:
        word = rank >> 6
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (rank & 63).astype(np.uint64))
        return self.before[word] + np.bitwise_count(self.words[word] & upto)


class RunIndex:
    """The run-compressed transform of stretches of text, through which they are matched with each other.

    Suffixes end with their stretch, equal ones are in the order of the stretches, and those of fewer than ``length`` - 1 bytes are
    left out, since no match of ``length`` bytes needs them. An LF step leads from a suffix to the one a byte further left, which has
    ``length`` bytes at least; so its rank among those is counted from the runs, and then shifted by the shortest ones before it.

    Kept are, for each run: its first rank, its byte (-1: the start of a stretch, each a run), where the suffixes that begin with its
    byte stand, and the text positions of its first and last suffix; the ranks of the shortest suffixes, by rank and by stretch;
    the thresholds (ranks whose suffix agrees with the one before in fewer than ``length`` bytes) and for each the rank of the string in
    its first document; the text."""

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int = LENGTH):
        self.length, self.text, self.start, self.size = length, text, start, size
        self.word = np.ndarray(len(text) + 1, "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place on
        count = size - length + 2
        stretch = np.repeat(np.arange(len(start)), count)
        place = np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)
        end = (start + size)[stretch]
        order, heads = _sort(text, place, end, stretch, length)
        place, stretch, end = place[order], stretch[order], end[order]
        n = len(place)
        short = end - place == length - 1
        before = np.where(place == start[stretch], -1, text[np.maximum(place - 1, 0)].astype(np.int64))
        self.run_start = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (before[1:] < 0))[:n])
        self.run_byte = before[self.run_start]
        run_len = np.diff(np.append(self.run_start, n))
        self.run_last = self.run_start + run_len - 1
        self.head_sample, self.tail_sample = place[self.run_start], place[self.run_last]
        # how many suffixes of length bytes or more begin with a smaller byte, and how many of a run's byte stand before the run
        smaller = np.append(0, np.cumsum(np.bincount(text[place[~short]], minlength=256)))[:256]
        by_byte = np.argsort(self.run_byte, kind="stable")
        sums, byte = np.cumsum(run_len[by_byte]) - run_len[by_byte], self.run_byte[by_byte]
        self.run_target = np.empty(len(byte), np.int64)
        self.run_target[by_byte] = smaller[np.maximum(byte, 0)] + sums - sums[np.searchsorted(byte, byte)]
        ranks = np.flatnonzero(short)
        self.shorts = ranks - np.arange(len(ranks))
        self.entry = np.empty(len(start), np.int64)
        self.entry[stretch[ranks]] = ranks
        self.runs, self.threshold = Marks(self.run_start, n), Marks(heads, n)
        group = self.threshold.last(np.arange(n))
        doc = np.where(short, np.iinfo(np.int64).max, owner[stretch])
        best = np.lexsort((place, doc, group))
        self.threshold_rank = best[np.searchsorted(group[best], np.arange(len(heads)))]
        self.n = n

    def lf(self, rank: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The rank of the suffix one byte further left."""
        among = self.run_target[run] + rank - self.run_start[run]
        return among + np.searchsorted(self.shorts, among, side="right")

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: LF steps until one is the first or last of a run."""
        out = np.empty(len(rank), np.int64)
        who, steps = np.arange(len(rank)), 0
        while len(who):
            run = self.runs.last(rank)
            head, tail = rank == self.run_start[run], rank == self.run_last[run]
            out[who[head]] = self.head_sample[run[head]] + steps
            out[who[tail]] = self.tail_sample[run[tail]] + steps
            go = ~(head | tail)
            who, rank, steps = who[go], self.lf(rank[go], run[go]), steps + 1
        return out

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """In how many bytes, at most so many, the text agrees at two positions."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):  # eight bytes at a time
            x = self.word[a[live] + out[live]] ^ self.word[b[live] + out[live]]
            same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, np.maximum(most, 0))

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of all stretches, right to left: (place of a string of ``length`` bytes, the position of its first
        place in its first document, the length of the match from there, up to the end of either stretch)."""
        first = self.locate(self.threshold_rank)
        ends = self.start + self.size
        room = ends[np.searchsorted(ends, first, side="right")] if len(first) else first
        rank, at, left = self.entry, ends - self.length + 1, self.size - self.length + 1
        stop, source, far = ends, np.full(len(at), -2), np.zeros(len(at), np.int64)
        places, sources, lengths = [], [], []
        while len(rank):
            rank, at = self.lf(rank, self.runs.last(rank)), at - 1
            t = self.threshold.last(rank)
            now = first[t]
            far = np.where(now + 1 == source, far + 1, 0)
            fresh = np.flatnonzero(far == 0)  # another match: at least length bytes, and on from there
            a, b = now[fresh] + self.length, at[fresh] + self.length
            far[fresh] = self.length + self._agree(a, b, np.minimum(room[t[fresh]] - a, stop[fresh] - b))
            source = now
            places.append(at)
            sources.append(source)
            lengths.append(far)
            more = left > 1
            rank, at, left, stop, source, far = rank[more], at[more], left[more] - 1, stop[more], source[more], far[more]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, sources, lengths))


def _sort(text: np.ndarray, place: np.ndarray, end: np.ndarray, stretch: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes' numbers in order, the ranks at which another string of ``length`` bytes begins).

    Eight bytes are compared at a time, a suffix's end being less than any byte; only ties are looked at again. Suffixes that are
    equal to their end are in the order of their stretches."""
    n = len(place)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    word = np.ndarray(len(text) + 1, ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place on
    left = end - place
    order = np.lexsort((stretch, left))  # what all sorts below leave alone: the shorter first
    new = np.zeros(n, bool)
    new[0] = True
    heads, at = None, 0
    steps = [*range(8, length, 8), length]
    tied = np.arange(n)
    while True:
        if at >= length and heads is None:
            heads = np.flatnonzero(new)
        first = np.flatnonzero(new[tied])
        size = np.diff(np.append(first, len(tied)))
        longest = np.maximum.reduceat(left[order[tied]], first) if len(tied) else first
        tied = tied[np.repeat((size > 1) & (longest > at), size)]
        if not len(tied):
            if heads is None:
                heads = np.flatnonzero(new)
            return order, heads
        width = min(8, next((x for x in steps if x > at), at + 8) - at)
        who = order[tied]
        rest = np.minimum(left[who] - at, width)
        key = np.where(rest > 0, word[np.minimum(place[who] + at, len(text))].astype(np.uint64), np.uint64(0))
        key &= ~((np.uint64(1) << (np.uint64(8) * (np.uint64(8) - np.clip(rest, 1, 8).astype(np.uint64)))) - np.uint64(1))
        group = np.cumsum(new[tied])
        by = np.lexsort((key, group)) if at else np.argsort(key, kind="stable")
        order[tied] = who[by]
        key, g = key[by], group[by]
        new[tied] |= np.append(True, (key[1:] != key[:-1]) | (g[1:] != g[:-1]))
        at += width


def _runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a bucket's stretches, the number of each one's runs of places with one source; and all runs' lengths and sources."""
    content = span_hashes(data, start, size)
    order = np.lexsort((doc, content))
    c = content[order]
    new = np.append(True, c[1:] != c[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]  # of each distinct stretch, the one with the smallest document
    by_doc = np.argsort(doc[one], kind="stable")
    rank = np.empty(len(one), np.int64)
    rank[by_doc] = np.arange(len(one))
    which, one = rank[which], one[by_doc]
    text, size_d = gather(data, start[one], size[one]), size[one]
    start_d = np.cumsum(size_d) - size_d
    index = RunIndex(text, start_d, size_d, doc[one], length)
    place, found, _ = index.stream()
    owner = doc[one][np.searchsorted(start_d, found[np.argsort(place)], side="right") - 1]
    # runs of places with one source, by stretch
    stretch = np.repeat(np.arange(len(one)), size_d - length + 1)
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1]))
    head = np.flatnonzero(fresh)
    runs_of = np.searchsorted(stretch[head], np.arange(len(one) + 1))
    run_len = np.diff(np.append(head, len(owner)))
    n_runs = np.diff(runs_of)[which]
    r = np.arange(int(n_runs.sum())) + np.repeat(runs_of[which] - (np.cumsum(n_runs) - n_runs), n_runs)
    return n_runs, run_len[r], owner[head[r]]


def _match(buckets: int, length: int):
    each, _ = grouping(buckets)

    def run(t: pa.Table) -> pa.Table:
        lots, group = t.column("lot").to_pylist(), t.column("bucket")[0].as_py()
        docs = [unpack(x) for x in t.column("docs").to_pylist()]
        inside = np.concatenate([np.repeat(np.arange(each), d[:each]) for d in docs])  # the bucket of each stretch
        docs = [d[each:] for d in docs]
        doc, size = np.concatenate(docs), np.concatenate([unpack(x) for x in t.column("sizes").to_pylist()])
        data = np.concatenate([np.frombuffer(unsqueeze(x), np.uint8) for x in t.column("data").to_pylist()])
        start = np.cumsum(size) - size
        order = np.argsort(inside, kind="stable")
        parts = []
        for of in np.split(order, np.flatnonzero(np.diff(inside[order])) + 1):
            parts.append(_runs(data, start[of], size[of], doc[of], length))
            release_memory()
        # the runs by stretch as the lots sent them
        by_bucket_runs, run_len, source = (np.concatenate(x) for x in zip(*parts, strict=True))
        n_runs, first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        n_runs[order], first[order] = by_bucket_runs, np.cumsum(by_bucket_runs) - by_bucket_runs
        rows, at = [], 0
        for lot, d in zip(lots, docs, strict=True):
            n, f = n_runs[at : at + len(d)], first[at : at + len(d)]
            at += len(d)
            ends = np.cumsum(n)
            r = np.arange(int(n.sum())) + np.repeat(f - (ends - n), n)
            # the last run's length follows from the stretch
            inner = np.ones(len(r), bool)
            inner[ends - 1] = False
            rows.append((2, lot, group, pack(n), pack(run_len[r[inner]]), pack(source[r] - np.repeat(d, n))))
        return table_of(rows, ANSWER)

    return tidy(run)


def _mark(buckets: int, length: int):
    def run(key: tuple, lots: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in lots.to_pylist():
            lot = Lot(row)
            s = Sent.of(lot, answers, buckets, length)
            got = sorted((r for r in answers.select(["kind", "bucket", "first", "second", "third"]).to_pylist() if r["kind"] == 2), key=lambda r: r["bucket"])
            cover = np.zeros(len(lot.data) + 1, np.int32)
            if got:
                n_runs = np.concatenate([unpack(r["first"]) for r in got])
                inner, source = (np.concatenate([unpack(r[c]) for r in got]) for c in ("second", "third"))
                total = s.stretches.count[s.first]
                last = np.cumsum(n_runs) - 1
                run_len = np.empty(len(source), np.int64)
                is_last = np.zeros(len(source), bool)
                is_last[last] = True
                run_len[~is_last] = inner
                run_len[is_last] = 0
                run_len[last] = total - np.add.reduceat(run_len, last - n_runs + 1)
                source = source + np.repeat(s.doc, n_runs)
                offset = np.cumsum(run_len) - run_len
                offset -= np.repeat(offset[last - n_runs + 1], n_runs)
                # every stretch of the lot, by the distinct one that it is
                n = n_runs[s.which]
                r = np.arange(int(n.sum())) + np.repeat((last - n_runs + 1)[s.which] - (np.cumsum(n) - n), n)
                owner = np.repeat(np.arange(len(s.which)), n)
                hit = source[r] < lot.ids[s.stretches.doc[owner]]
                a = s.stretches.start[owner[hit]] + offset[r[hit]]
                b = a + run_len[r[hit]] + length - 1
                np.add.at(cover, a, 1)
                np.add.at(cover, b, -1)
            gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
            edge = np.zeros(len(gone), bool)
            edge[lot.offs[:-1][np.diff(lot.offs) > 0]] = True
            begins = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
            stops = np.flatnonzero(gone & np.append(edge[1:] | ~gone[1:], True)) + 1
            at = np.searchsorted(begins, lot.offs)
            total = np.append(0, np.cumsum(gone, dtype=np.int32))[lot.offs].astype(np.int64)
            kept = lot.data[~gone].tobytes()
            keep_at = lot.offs - total
            sha = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(keep_at[:-1].tolist(), keep_at[1:].tolist(), strict=True)]
            base = np.repeat(lot.offs[:-1], np.diff(at))
            spans = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((x - base).astype(np.int32))) for x in (begins, stops)]
            cols = [lot.id_array(), pa.array(np.diff(lot.offs)), pa.array(np.diff(total)), pa.array(np.diff(at)), pa.array(sha, pa.string()), *spans]
            out.append(pa.Table.from_arrays(cols, names=[c.split()[0] for c in RESULT_SCHEMA.split(", ")]))
        return pa.concat_tables(out)

    return tidy(run)


def duplicate_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of docs(doc_id, text): per document its bytes, the removed spans (byte offsets), and the digest of what is left."""
    if length < SEED + 2:
        raise ValueError(f"the length must be over {SEED + 1}")
    buckets = max(8, -(-input_bytes(docs) // BUCKET_BYTES))
    lots = store(docs, F.lit(False), LOT_BYTES)
    asked = lots.mapInArrow(_ask(buckets, length), ASK_SCHEMA)
    shared = materialise(asked.groupBy("bucket").applyInArrow(tidy(_shared), ANSWER_SCHEMA), "shared-minimizers")
    texts = lots.groupBy("lot").cogroup(shared.groupBy("lot")).applyInArrow(_send(buckets, length), TEXT_SCHEMA)
    found = materialise(texts.groupBy("bucket").applyInArrow(_match(buckets, length), ANSWER_SCHEMA), "matches")
    answers = shared.unionByName(found)
    return lots.groupBy("lot").cogroup(answers.groupBy("lot")).applyInArrow(_mark(buckets, length), RESULT_SCHEMA)
