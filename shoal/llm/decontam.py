"""Benchmark decontamination over a document-sharded positional inverted index.

``build_index`` turns a corpus into a stored table of shards. A shard holds, for some megabytes of documents, the
positional postings of every term of the training texts, sorted by term and position. ``phrase_matches`` evaluates phrases
shard by shard: it starts from the postings of the term that is rarest in the whole corpus and intersects them with the
offset-adjusted postings of the next rarest terms. ``proximity_matches`` does the same with a tolerance. Shards are
independent: no posting list is ever gathered in one place, however frequent its term is. The index does not depend on the
phrases: it is built once and serves any number of blocks of them; a bounded block is sent to the tasks at a time.

Nulls have no words; empty texts match nothing; repeated rows, and rows that share an id, are reported once each; an empty
table gives no rows; extra columns are ignored. Items without an id have windows that hit words, but are no item that could be
listed. A very long text is one shard of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, chunks, column_bytes, list_array, lower_ascii, materialise, release_memory, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Windows that are sent to the tasks at once; more are evaluated block by block.
BLOCK_WINDOWS = 500_000
#: Free positions between two documents of a shard.
GAP = 1

#: Stands for the id of an item that has none.
NO_ITEM = np.iinfo(np.int64).min

INDEX_SCHEMA = "shard long, docs array<long>, n_words array<int>, terms array<long>, counts array<int>, places array<int>"
HIT_SCHEMA = "shard long, at int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<long>"
RESULT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>"

_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_ASCII_LOWER))


@dataclass
class Phrases:
    """A block of phrases: term numbers (rows padded with -1), lengths, the item of each; and the sorted term hashes."""

    terms: np.ndarray
    length: np.ndarray
    item: np.ndarray
    vocab: np.ndarray

    @classmethod
    def of(cls, phrases: list[tuple[int, list[str]]], width: int) -> Phrases:
        uniq = sorted({w for _, ws in phrases for w in ws})
        data = [w.encode("utf-8", "surrogatepass") for w in uniq]
        offs = np.cumsum([0, *map(len, data)])
        # each word is a document of its own, so its bytes are one word
        h = words(np.frombuffer(b"".join(data), np.uint8), offs, np.ones(256, bool))[2]
        order = np.argsort(h)
        number = np.empty(len(uniq), np.int32)
        number[order] = np.arange(len(uniq), dtype=np.int32)
        at = dict(zip(uniq, number.tolist(), strict=True))
        terms = np.full((len(phrases), width), -1, np.int32)
        for k, (_, ws) in enumerate(phrases):
            terms[k, : len(ws)] = [at[w] for w in ws]
        return cls(terms, np.array([len(ws) for _, ws in phrases], np.int32), np.array([i for i, _ in phrases], np.int64), h[order])


def windows(items: list[tuple[int, str | None]], n: int) -> list[tuple[int, list[str]]]:
    """Each window of n consecutive words of an item; an item of fewer, but not none, is one window."""
    out = []
    for item, text in items:
        ws = tokens(text)
        if ws:
            out += [(item, ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
    return list({(i, tuple(w)): (i, w) for i, w in out}.values())


def _index_chunk(ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> list:
    _, _, h, per = words(lower_ascii(data), offs, ALNUM)
    base = np.concatenate([[0], np.cumsum(per + GAP)])
    doc = np.repeat(np.arange(len(per)), per)
    place = (np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per) + base[doc]).astype(np.int32)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(h)))
    return [ids, per.astype(np.int32), h[first].view(np.int64), counts.astype(np.int32), place[order]]


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs(doc_id, text): a row a shard, with the postings of all its terms by their hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for b in batches:
            data, offs = column_bytes(b.column("text"))
            ids = b.column("doc_id").cast(pa.int64())
            for i, j in chunks(offs):
                cut = _index_chunk(ids.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                one = lambda a: list_array(a, np.array([0, len(a)]))
                docs_col = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), cut[0])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), docs_col, *map(one, cut[1:])], names=["shard", "docs", "n_words", "terms", "counts", "places"])
                shard += 1
            release_memory()

    return materialise(docs.select("doc_id", "text").mapInArrow(build, INDEX_SCHEMA), "positional-index")


def _found_terms(vocab: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the vocabulary's hashes are terms of a shard, their places in it); both are sorted."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, vocab), len(terms) - 1)
    have = np.flatnonzero(terms[at] == vocab)
    return have, at[have]


def term_counts(index: DataFrame, vocab: np.ndarray) -> np.ndarray:
    """How often each term of a vocabulary occurs in the whole corpus: summed within each partition, then over all."""
    sent = index.sparkSession.sparkContext.broadcast(vocab)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                terms, counts = (b.column(c).slice(r, 1).flatten().to_numpy() for c in ("terms", "counts"))
                have, at = _found_terms(sent.value, terms.view(np.uint64))
                total[have] += counts[at]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(len(vocab), np.int64)
    rows = index.select("terms", "counts").mapInArrow(sums, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    for term, n in rows:
        out[term] = n
    return out


def _intersect(ph: Phrases, order: np.ndarray, slack: int, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, base: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, place of its first word, document) of the matches in one shard. order: each phrase's offsets from its rarest term on."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(terms) or not len(ph.length):
        return none
    n = len(ph.vocab)
    have, at = _found_terms(ph.vocab, terms.view(np.uint64))
    begins = np.cumsum(counts, dtype=np.int64) - counts
    first, size_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[have], size_of[have] = begins[at], counts[at]
    rows = np.arange(len(ph.length))
    pivot = ph.terms[rows, order[:, 0]]
    live = np.flatnonzero(size_of[pivot])
    size = size_of[pivot[live]]
    if not len(live):
        return none
    phrase = np.repeat(live, size)
    within = np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size, size)
    stands = places[first[pivot[phrase]] + within].astype(np.int64)
    doc = np.searchsorted(base, stands, side="right") - 1  # the rarest term's own place tells the document
    start = stands - order[phrase, 0]
    if slack:
        shift = np.tile(np.arange(-slack, slack + 1), len(phrase))
        phrase, start, doc = (np.repeat(x, 2 * slack + 1) for x in (phrase, start, doc))
        start = start + shift
    big = np.int64(1) << 32
    mine = counts[at].astype(np.int64)
    posting = np.arange(int(mine.sum())) + np.repeat(begins[at] - (np.cumsum(mine) - mine), mine)
    keys = np.repeat(have, mine) * big + places[posting]
    for k in range(1, order.shape[1]):
        if not len(phrase):
            break
        off = order[phrase, k]
        more = off >= 0
        tag = ph.terms[phrase, np.maximum(off, 0)].astype(np.int64) * big
        low = np.maximum(start + off - slack, base[doc])
        high = np.minimum(start + off + slack, base[doc] + per[doc] - 1)
        at = np.minimum(np.searchsorted(keys, tag + low), len(keys) - 1)
        ok = ~more | ((low <= high) & (keys[at] >= tag + low) & (keys[at] <= tag + high))
        phrase, start, doc = phrase[ok], start[ok], doc[ok]
    return phrase, start, doc


def matches(index: DataFrame, ph: Phrases, df: np.ndarray, slack: int = 0) -> DataFrame:
    """For each document of the index: its number of words, the matches as [start, end) word numbers, their items.

    slack 0: exact phrases. Otherwise a start matches if every term of the phrase stands in the document within slack words
    of its place, counted from that start; the first start of each row of neighbouring ones is given, at least 0. Which term is
    the rarest decides only where the search begins."""
    rarity = np.where(ph.terms >= 0, df[np.maximum(ph.terms, 0)] if len(df) else 0, np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable").astype(np.int64)
    order = np.where(np.arange(ph.terms.shape[1])[None, :] < ph.length[:, None], order, -1)
    seen = ((ph.terms < 0) | (rarity > 0)).all(axis=1)  # else some term is in no document
    ph = Phrases(ph.terms[seen], ph.length[seen], ph.item[seen], ph.vocab)
    order = order[seen]
    sent = index.sparkSession.sparkContext.broadcast((ph, order))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph, order = sent.value
        for b in batches:
            for r in range(b.num_rows):
                ids, per, terms, counts, places = (b.column(c).slice(r, 1).flatten() for c in ("docs", "n_words", "terms", "counts", "places"))
                per, terms, counts, places = (x.to_numpy() for x in (per, terms, counts, places))
                base = np.concatenate([[0], np.cumsum(per.astype(np.int64) + GAP)])
                phrase, start, doc = _intersect(ph, order, slack, terms, counts, places, base, per)
                s = start - base[doc]
                if slack:
                    s = np.maximum(s, 0)
                    by = np.lexsort((s, phrase, doc))
                    phrase, s, doc = phrase[by], s[by], doc[by]
                    new = np.append(True, (phrase[1:] != phrase[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + 1))[: len(s)]
                    phrase, s, doc = phrase[new], s[new], doc[new]
                else:
                    inside = (s >= 0) & (s + ph.length[phrase] <= per[doc])
                    phrase, s, doc = phrase[inside], s[inside], doc[inside]
                by = np.lexsort((s, doc))
                phrase, s, doc = phrase[by], s[by].astype(np.int32), doc[by]
                offs = np.searchsorted(doc, np.arange(len(per) + 1))
                ends = np.minimum(s + ph.length[phrase], per[doc]).astype(np.int32)
                shard = pa.array(np.full(len(per), b.column("shard")[r].as_py()))
                cols = [shard, pa.array(np.arange(len(per), dtype=np.int32)), ids, pa.array(per.astype(np.int64)), list_array(s, offs), list_array(ends, offs), list_array(ph.item[phrase], offs)]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in HIT_SCHEMA.split(", ")])
            release_memory()

    return index.mapInArrow(find, HIT_SCHEMA)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for b in batches:
        n = b.num_rows
        hit, count, sha, items = [0] * n, [0] * n, [empty] * n, [[]] * n
        size = np.diff(np.asarray(b.column("starts").offsets))
        for r in np.flatnonzero(size).tolist():
            s, e = (np.array(b.column(c)[r].as_py()) for c in ("starts", "ends"))
            line = np.zeros(e.max() + 1, np.int64)
            np.add.at(line, s, 1)
            np.add.at(line, e, -1)
            hit[r] = int((np.cumsum(line) > 0).sum())
            names = sorted({str(x) for x in b.column("items")[r].as_py() if x != NO_ITEM})
            count[r], sha[r], items[r] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sorted(map(int, names))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: words, words inside any occurrence of a benchmark window of n words, and the items that occur.

    Items with no words have no window. The benchmark is read in blocks of about block_windows windows, so its size is
    bounded at the driver and in each task; all blocks are intersected with one index."""
    chars = benchmark.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0]
    blocks = max(1, -(-int(chars or 0) // 2 // block_windows))
    index = build_index(docs)
    found = None
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else benchmark
        listed = part.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ITEM)), "text").collect()
        ph = Phrases.of(windows([(r[0], r[1]) for r in listed], n), n)
        hits = matches(index, ph, term_counts(index, ph.vocab))
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:  # a row's matches come together from all blocks
        merged = (F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items"))
        found = found.groupBy("shard", "at").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *merged).select(found.columns)
    return found.mapInArrow(_summary, RESULT_SCHEMA)


def proximity_matches(spark: SparkSession, docs: DataFrame, phrases: list[tuple[int, str]], slack: int) -> DataFrame:
    """(doc_id, item, start): starts in documents from which all terms of a phrase stand within slack words of their places."""
    listed = [(i, tokens(t)) for i, t in phrases]
    listed = [x for x in listed if x[1]]
    if slack < 0:
        raise ValueError("slack must not be negative")
    ph = Phrases.of(listed, max([1, *(len(w) for _, w in listed)]))
    index = build_index(docs)
    found = matches(index, ph, term_counts(index, ph.vocab), slack)
    both = found.select("doc_id", F.explode(F.arrays_zip("items", "starts")).alias("m"))
    return both.select("doc_id", F.col("m.items").alias("item"), F.col("m.starts").alias("start")).distinct()
