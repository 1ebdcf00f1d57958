"""Katz backoff language model: Good-Turing discounted bigram and unigram counts, with exactly normalised backoff weights.

Tokens are words between white space with A-Z lower-cased, and one end token a document; the first token's context is a start
mark. Counts are gathered over all training documents, in tables that are partitioned by a hash of the item; every lot of
documents asks these tables for the counts of what stands in it (see ``lots``). A frequent context is dealt to several buckets,
by the following word, so no bucket holds more than its share.

  P(w | v) = d(c(v w)) c(v w) / c(v)      if v w was seen
           = a(v) P(w)                    otherwise
  P(w)     = d(c(w)) c(w) / N             if w was seen, and what is left over for an unknown word

d are Katz's discounts for counts up to K from the counts of counts of each order (absolute discounting, where these are not
between 0 and 1), and a(v) = (1 - sum of the seen P(w | v)) / (1 - sum of P(w) over the seen w). A context without discounted
counts is treated as if it was seen once more. An unknown context backs off with weight 1.

Null and empty texts consist of the end token. With no training document N and V are 0 and every score is the unknown word's.
Repeated rows count and are scored each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, input_bytes, lower_ascii, materialise, mix, release_memory, tidy, words
from .lots import Lot, by_bucket, pack, store, table_of, unpack

#: Counts above K are not discounted.
K = 5
#: Occurrences of a context for each bucket that it is dealt to.
SPLIT = 1 << 19
#: Input bytes for each bucket.
BUCKET_BYTES = 4 << 20
END = np.uint64(0x656E64)
START = np.uint64(0x7374617274)

WORD_ASK = [("bucket", pa.int32()), ("lot", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
WORD_ASK_SCHEMA = "bucket int, lot long, keys binary, counts binary"
PAIR_ASK = [("bucket", pa.int32()), ("lot", pa.int64()), ("contexts", pa.binary()), ("runs", pa.binary()), ("nexts", pa.binary()), ("counts", pa.binary()), ("totals", pa.binary())]
PAIR_ASK_SCHEMA = "bucket int, lot long, contexts binary, runs binary, nexts binary, counts binary, totals binary"
ANSWER = [("kind", pa.int32()), ("lot", pa.int64()), ("bucket", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("third", pa.binary()), ("stats", pa.list_(pa.int64()))]
ANSWER_SCHEMA = "kind int, lot long, bucket int, first binary, second binary, third binary, stats array<long>"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Order:
    """Totals of one order: tokens, types, and discounts of the counts 0 to K (0 unused)."""

    tokens: int
    types: int
    discount: np.ndarray

    @classmethod
    def of(cls, tokens: int, types: int, of_counts: np.ndarray) -> Order:
        """of_counts[r]: how many types were seen r times, r up to K + 1."""
        d = np.ones(K + 1)
        n = np.asarray(of_counts, float)
        good = bool((n[1 : K + 2] > 0).all())
        if good:
            r = np.arange(1, K + 1)
            common = (K + 1) * n[K + 1] / n[1]
            d[1:] = ((r + 1) * n[2 : K + 2] / n[1 : K + 1] / r - common) / (1 - common) if common != 1 else 0
            good = bool(((d[1:] > 0) & (d[1:] < 1)).all())
        if not good:
            cut = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
            cut = min(max(cut, 0.01), 0.99)
            d[1:] = 1 - cut / np.arange(1, K + 1)
        return cls(tokens, types, d)

    def reduced(self, counts: np.ndarray) -> np.ndarray:
        """d(c) c."""
        return np.where(counts > K, 1.0, self.discount[np.minimum(counts, K)]) * counts


def unknown(order: Order, of_counts: np.ndarray) -> float:
    """The probability that the discounted unigrams leave for an unknown word."""
    if not order.tokens:
        return 1.0
    r = np.arange(1, K + 1)
    left = float((of_counts[1 : K + 1] * r * (1 - order.discount[1:])).sum()) / order.tokens
    return left if left > 0 else 1.0 / (order.tokens + 1)


@dataclass
class Tokens:
    """A lot's tokens: for each its distinct-word number, its document; the distinct word hashes, sorted."""

    keys: np.ndarray
    which: np.ndarray
    doc: np.ndarray
    per: np.ndarray

    @classmethod
    def of(cls, lot: Lot) -> Tokens:
        _, _, h, per = words(lower_ascii(lot.data), lot.offs, NONSPACE)
        ends = np.cumsum(per)
        h = np.insert(h, ends, END)
        per = per + 1
        keys, which = np.unique(h, return_inverse=True)
        return cls(keys, which, np.repeat(np.arange(len(per)), per), per)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lot = Lot(row)
                t = Tokens.of(lot)
                counts = np.bincount(t.which, weights=lot.flags[t.doc], minlength=len(t.keys)).astype(np.int64)
                bucket = _bucket(t.keys, buckets)  # grows with the key
                rows = [(k, row["lot"], pack(np.diff(t.keys[s], prepend=np.uint64(0))), pack(counts[s])) for k, s in by_bucket(bucket, buckets)]
                yield from table_of(rows, WORD_ASK).to_batches()
                release_memory()

    return run


def _count_words(t: pa.Table) -> pa.Table:
    """A bucket's words: to each lot the total and the bucket's number of each of its words; and the bucket's totals."""
    lots, bucket = t.column("lot").to_pylist(), t.column("bucket")[0].as_py()
    keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()]
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([unpack(x) for x in t.column("counts").to_pylist()])).astype(np.int64)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(every))
    rows, at = [], 0
    for lot, k in zip(lots, keys, strict=True):
        w = which[at : at + len(k)]
        at += len(k)
        rows.append((1, lot, bucket, pack(total[w]), pack(rank[w]), None, None))
    seen = total[total > 0]
    of_counts = np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[: K + 2]
    rows.append((0, None, bucket, None, None, None, [int(seen.sum()), len(seen), len(every), *of_counts.tolist()]))
    return table_of(rows, ANSWER)


@dataclass
class Asked:
    """A lot's tokens with what the word tables answered."""

    tokens: Tokens
    total: np.ndarray  # by distinct word
    number: np.ndarray  # by distinct word: its number in the whole vocabulary, from 1; 0 is the start mark
    pairs: np.ndarray = None  # distinct (context, next) numbers, n x 2
    which: np.ndarray = None  # of each token, its pair

    @classmethod
    def of(cls, lot: Lot, answers: pa.Table, base: np.ndarray) -> Asked:
        t = Tokens.of(lot)
        got = sorted((r for r in answers.select(["kind", "bucket", "first", "second"]).to_pylist() if r["kind"] == 1), key=lambda r: r["bucket"])
        total = np.concatenate([unpack(r["first"]) for r in got])
        number = np.concatenate([unpack(r["second"]) + base[r["bucket"]] + 1 for r in got])
        return cls(t, total, number)

    def find_pairs(self) -> None:
        number = self.number[self.tokens.which]
        context = np.roll(number, 1)
        context[np.cumsum(self.tokens.per) - self.tokens.per] = 0
        if number.max(initial=0) < 1 << 31:
            key, self.which = np.unique((context << 32) | number, return_inverse=True)
            self.pairs = np.stack([key >> 32, key & 0xFFFFFFFF], 1)
        else:
            self.pairs, self.which = np.unique(np.stack([context, number], 1), axis=0, return_inverse=True)


class Sent:
    """How a lot's pairs are dealt to buckets: pairs in bucket order, and the contexts of each bucket."""

    def __init__(self, a: Asked, buckets: int, starts: int):
        order = np.argsort(a.number, kind="stable")
        names, sizes = np.append(0, a.number[order]), np.append(starts, a.total[order])
        self.context_at = np.searchsorted(names, a.pairs[:, 0])
        self.next_total = sizes[np.searchsorted(names, a.pairs[:, 1])]
        self.context_total = sizes[self.context_at]
        parts = 1 + sizes // SPLIT
        part = a.pairs[:, 1] % parts[self.context_at]
        deal = lambda context, part: (mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        bucket = deal(a.pairs[:, 0], part)
        # every part of a context is asked, also those that none of this lot's pairs is in
        used = np.unique(self.context_at)
        n = parts[used]
        again = np.repeat(used, n)
        which_part = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
        ask_bucket = deal(names[again], which_part)
        both = np.unique(np.stack([ask_bucket, names[again]], 1), axis=0)
        self.ask_bucket, self.ask_context = both[:, 0], both[:, 1]
        self.order = np.lexsort((a.pairs[:, 1], a.pairs[:, 0], bucket))
        self.bucket = bucket[self.order]
        self.buckets = buckets


def _ask_pairs(buckets: int, base: np.ndarray, starts: int):
    def run(key: tuple, lots: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in lots.to_pylist():
            lot = Lot(row)
            a = Asked.of(lot, answers, base)
            a.find_pairs()
            counts = np.bincount(a.which, weights=lot.flags[a.tokens.doc], minlength=len(a.pairs)).astype(np.int64)
            s = Sent(a, buckets, starts)
            pairs, counts, totals = a.pairs[s.order], counts[s.order], s.next_total[s.order]
            cut = np.searchsorted(s.bucket, np.arange(buckets + 1))
            for k, sl in by_bucket(s.ask_bucket, buckets):
                contexts, p = s.ask_context[sl], slice(int(cut[k]), int(cut[k + 1]))
                runs = np.diff(np.searchsorted(pairs[p, 0], np.append(contexts, np.iinfo(np.int64).max)))
                rows.append((k, row["lot"], pack(np.diff(contexts, prepend=0)), pack(runs), pack(pairs[p, 1]), pack(counts[p]), pack(totals[p])))
        return table_of(rows, PAIR_ASK)

    return tidy(run)


def _count_pairs(uni: Order):
    def run(t: pa.Table) -> pa.Table:
        lots, bucket = t.column("lot").to_pylist(), t.column("bucket")[0].as_py()
        contexts = [np.cumsum(unpack(x)) for x in t.column("contexts").to_pylist()]
        runs = [unpack(x) for x in t.column("runs").to_pylist()]
        context = np.concatenate([np.repeat(c, r) for c, r in zip(contexts, runs, strict=True)])
        following, count, after = (np.concatenate([unpack(x) for x in t.column(c).to_pylist()]) for c in ("nexts", "counts", "totals"))
        if max(context.max(initial=0), following.max(initial=0)) < 1 << 31:
            _, first, which = np.unique((context << 32) | following, return_index=True, return_inverse=True)
        else:
            _, first, which = np.unique(np.stack([context, following], 1), axis=0, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=count, minlength=len(first)).astype(np.int64)
        # of each context: how many followers were seen 1 to K times (20 bits each would do; kept apart), and their unigram mass
        names, at = np.unique(context[first], return_inverse=True) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        seen = total > 0
        mass = np.bincount(at, weights=np.where(seen, uni.reduced(after[first]), 0.0), minlength=len(names))
        few = np.zeros((K, len(names)), np.int64)
        for r in range(1, K + 1):
            few[r - 1] = np.bincount(at, weights=total == r, minlength=len(names))
        rows, p = [], 0
        for lot, c, r in zip(lots, contexts, runs, strict=True):
            n = int(r.sum())
            k = np.searchsorted(names, c)
            k[k == len(names)] = 0
            ok = names[k] == c if len(names) else np.zeros(len(c), bool)
            mine = np.where(ok, mass[k], 0.0) if len(names) else np.zeros(len(c))
            counts = np.where(ok, few[:, k], 0) if len(names) else np.zeros((K, len(c)), np.int64)
            rows.append((2, lot, bucket, pack(total[which[p : p + n]]), pack(mine), pack(counts.ravel()), None))
            p += n
        of_counts = np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3)[: K + 2]
        rows.append((0, None, bucket, None, None, None, [int(total.sum()), int(seen.sum()), 0, *of_counts.tolist()]))
        return table_of(rows, ANSWER)

    return tidy(run)


def _score(buckets: int, base: np.ndarray, starts: int, uni: Order, two: Order, rest: float):
    def run(key: tuple, lots: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in lots.to_pylist():
            lot = Lot(row)
            a = Asked.of(lot, answers, base)
            a.find_pairs()
            s = Sent(a, buckets, starts)
            got = sorted((r for r in answers.select(["kind", "bucket", "first", "second", "third"]).to_pylist() if r["kind"] == 2), key=lambda r: r["bucket"])
            count = np.empty(len(a.pairs), np.int64)
            count[s.order] = np.concatenate([unpack(r["first"]) for r in got])
            names, at = np.unique(s.ask_context, return_inverse=True)
            mass = np.bincount(at, weights=np.concatenate([unpack(r["second"], np.float64) for r in got]), minlength=len(names))
            few = np.concatenate([unpack(r["third"]).reshape(K, -1) for r in got], axis=1)
            r = np.arange(1, K + 1)
            freed = np.bincount(at, weights=(r * (1 - two.discount[1:])) @ few, minlength=len(names))
            k = np.searchsorted(names, a.pairs[:, 0])
            total = s.context_total.astype(float)
            n = max(uni.tokens, 1)
            single = np.where(s.next_total > 0, uni.reduced(s.next_total) / n, rest)
            left, size = freed[k], total.copy()
            undiscounted = (total > 0) & (left <= 0)
            left = np.where(undiscounted, 1.0, left)
            size = np.where(undiscounted, total + 1, np.maximum(total, 1))
            weight = np.where(total > 0, left / size / np.maximum(1 - mass[k] / n, 1e-300), 1.0)
            p = np.where(count > 0, two.reduced(count) / size, weight * single)
            t = a.tokens
            known = a.total[t.which]
            docs = len(t.per)
            base_p = np.log10((known + 1) / (uni.tokens + (uni.types + 1)))
            add = lambda w: np.bincount(t.doc, weights=w, minlength=docs)
            score = add(np.log10(np.maximum(p, 1e-300))[a.which])
            cols = [lot.id_array(), pa.array(~lot.flags), pa.array(t.per), pa.array(add(known > 0).astype(np.int64)), pa.array(np.full(docs, uni.tokens)), pa.array(add(base_p)), pa.array(score)]
            out.append(pa.Table.from_arrays(cols, names=[c.split()[0] for c in SCORE_SCHEMA.split(", ")]))
        return pa.concat_tables(out) if out else pa.table({c.split()[0]: [] for c in SCORE_SCHEMA.split(", ")})

    return tidy(run)


def _totals(answers: DataFrame) -> tuple[int, int, np.ndarray, list[tuple[int, int]]]:
    """Sums of the buckets' totals, and each bucket's number of words (a few numbers a bucket)."""
    rows = answers.where("kind = 0").select("bucket", "stats").collect()
    stats = np.array([r["stats"] for r in rows], np.int64).reshape(len(rows), K + 5)
    sums = stats.sum(0) if len(rows) else np.zeros(K + 5, np.int64)
    return int(sums[0]), int(sums[1]), sums[3:], [(r["bucket"], r["stats"][2]) for r in rows]


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Train on the rows that meet the condition on doc_id and score all rows of docs(doc_id, text)."""
    buckets = max(8, -(-input_bytes(docs) // BUCKET_BYTES))
    lots = store(docs, train)
    asked = lots.mapInArrow(_ask_words(buckets), WORD_ASK_SCHEMA)
    words_out = materialise(asked.groupBy("bucket").applyInArrow(tidy(_count_words), ANSWER_SCHEMA), "word-counts")
    tokens, types, of_counts, sizes = _totals(words_out)
    uni = Order.of(tokens, types, of_counts)
    base = np.zeros(buckets + 1, np.int64)
    for b, n in sizes:
        base[b + 1] = n
    base = np.cumsum(base)[:-1]
    trained = lots.mapInArrow(_flagged, "n long").agg(F.sum("n")).first()[0] or 0
    one = words_out.where("kind = 1")
    pairs = lots.groupBy("lot").cogroup(one.groupBy("lot")).applyInArrow(_ask_pairs(buckets, base, trained), PAIR_ASK_SCHEMA)
    pairs_out = materialise(pairs.groupBy("bucket").applyInArrow(_count_pairs(uni), ANSWER_SCHEMA), "pair-counts")
    pair_tokens, pair_types, pair_counts, _ = _totals(pairs_out)
    two = Order.of(pair_tokens, pair_types, pair_counts)
    answers = one.unionByName(pairs_out.where("kind = 2"))
    run = _score(buckets, base, trained, uni, two, unknown(uni, of_counts))
    return lots.groupBy("lot").cogroup(answers.groupBy("lot")).applyInArrow(run, SCORE_SCHEMA)


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .lots import unsqueeze

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(unsqueeze(x), bool).sum()) for x in b.column("flags").to_pylist()], pa.int64())], names=["n"])
