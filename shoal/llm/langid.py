"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words. Piece probabilities come from
expectation-maximisation (forward-backward counts) over word counts of a bounded sample of labelled texts, drawn by the
hash of the id (``MAX_DOCS``, ``MAX_BYTES`` over all languages, no text over a language's share of the bytes); every language is trained
in a task of its own. Whole texts are scored, with word scores kept between texts.

Words stand between white space, A-Z lower-cased; a word starts with the vocabulary's word mark, and a code point outside the
vocabulary has a small fixed probability. Words of any length are summed over all their segmentations: those of up to
``MAX_WORD`` code points side by side, longer ones each on its own in the logarithmic domain.

A null text, or one without a letter, is ``und`` with score 1; so is every text if nothing could be learned. A very long text is
scored whole. Equal likelihoods go to the language that comes first in the alphabet. Repeated rows get the same answer; rows
without an id are scored, not learned from; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, chunks, column_bytes, lower_ascii, mix, words

MARK = "▁"
MAX_DOCS = 4000
MAX_BYTES = 8 << 20
MAX_WORD = 40
ROUNDS = 4
#: Probability of an unknown code point, and what every piece has at least, as a share of all.
UNKNOWN = 1e-7
SMOOTH = 0.05
#: Words whose scores are kept.
KEEP = 1 << 20
#: Keeps forward sums of long words within the floating-point range.
LIFT = 24.0
UNDETERMINED = "und"

_B = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """The pieces' hashes, sorted, with a bit table that rules most strings out, and the longest piece's length."""

    hashes: np.ndarray
    bits: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> Vocabulary:
        h = np.unique(np.array([string_hash(p) for p in pieces], np.uint64))
        bits = np.zeros(1 << 22, bool)
        bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return cls(h, bits, max(map(len, pieces)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h are pieces, their numbers)."""
        maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[maybe]
        return maybe[ok], at[ok]


def string_hash(s: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32):
        h = h * _B + np.uint64(int(c) + 1)
    return int(mix(h)[0])


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class LongWord:
    """One word of any length: its pieces by where they end, and sums over all segmentations in the logarithmic domain."""

    def __init__(self, word: str, vocab: Vocabulary):
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.size = n = len(code)
        h, starts, pieces, ends = np.zeros(n, np.uint64), [], [], []
        for m in range(1, min(vocab.longest, n) + 1):
            h = h[: n - m + 1] * _B + code[m - 1 :]
            hit, piece = vocab.find(mix(h))
            if m == 1:  # a code point that is no piece is an unknown one
                alone = np.setdiff1d(np.arange(n), hit)
                hit, piece = np.append(hit, alone), np.append(piece, np.full(len(alone), -1))
            starts.append(hit)
            pieces.append(piece)
            ends.append(hit + m)
        s, p, e = (np.concatenate(x) for x in (starts, pieces, ends))
        by = np.argsort(e, kind="stable")
        self.s, self.p, self.e = s[by], p[by], e[by]
        self.cut = np.searchsorted(self.e, np.arange(n + 2))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """log of the forward sums: positions x languages. logs: of a table of pieces x languages."""
        out = np.full((self.size + 1, logs.shape[1]), -np.inf)
        out[0] = 0
        w = logs[self.p]
        for j in range(1, self.size + 1):
            x = slice(self.cut[j], self.cut[j + 1])
            out[j] = np.logaddexp.reduce(out[self.s[x]] + w[x], axis=0)
        return out

    def expected(self, logs: np.ndarray) -> np.ndarray:
        """Expected piece counts for a table of one language."""
        a, b = self.forward(logs)[:, 0], np.full(self.size + 1, -np.inf)
        b[-1] = 0
        w = logs[self.p, 0]
        by = np.argsort(-self.s, kind="stable")
        cut = np.searchsorted(-self.s[by], -np.arange(self.size, -2, -1))
        for k, j in enumerate(range(self.size, -1, -1)):
            x = by[cut[k] : cut[k + 1]]
            if len(x):
                b[j] = np.logaddexp.reduce(w[x] + b[self.e[x]])
        gamma = np.exp(a[self.s] + w + b[self.e] - a[-1])
        known = self.p >= 0
        return np.bincount(self.p[known], weights=gamma[known], minlength=len(logs) - 1)


class Lattice:
    """All pieces in a list of words: for each length the start positions, and the pieces there."""

    def __init__(self, found: list[str], vocab: Vocabulary):
        marked = [MARK + w for w in found]
        owner = [k for k, w in enumerate(marked) if len(w) <= MAX_WORD]
        parts = [marked[k] for k in owner]
        self.long = [(k, LongWord(w, vocab)) for k, w in enumerate(marked) if len(w) > MAX_WORD]
        self.owner = np.array(owner, np.int64)
        self.n_words = len(found)
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        size = np.array([len(p) for p in parts], np.int64)
        self.size = size
        # words side by side, longest first, so that step j touches a leading run of words
        self.rank = np.argsort(-size, kind="stable")
        self.start = np.cumsum(size) - size
        left = np.repeat(self.start + size, size) - np.arange(len(code))
        part = np.repeat(np.arange(len(parts)), size)
        inside = np.arange(len(code)) - self.start[part]
        col = np.empty(len(parts), np.int64)
        col[self.rank] = np.arange(len(parts))
        self.col, self.part, self.inside = col, part, inside
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []  # column, start, piece, length
        h = np.zeros(len(code), np.uint64)
        live = np.arange(len(code))
        for n in range(1, vocab.longest + 1):
            live = live[left[live] >= n]
            h[live] = h[live] * _B + code[live + n - 1]
            hit, piece = vocab.find(mix(h[live]))
            at = live[hit]
            known = np.full(0, -1)
            if n == 1:
                have = np.zeros(len(code), bool)
                have[at] = True
                known = np.flatnonzero(~have)
            c = np.concatenate([col[part[at]], col[part[known]]]) if n == 1 else col[part[at]]
            s = np.concatenate([inside[at], inside[known]]) if n == 1 else inside[at]
            p = np.concatenate([piece, np.full(len(known), -1)]) if n == 1 else piece
            self.arcs.append((c, s, p, n))
        self.width = int(size.max(initial=0))
        # arcs by where they end, then by where they start
        c, s, p = (np.concatenate([a[i] for a in self.arcs]) for i in range(3))
        n = np.concatenate([np.full(len(a[0]), a[3]) for a in self.arcs])
        e = s + n
        by = np.argsort(e, kind="stable")
        self.c, self.s, self.p, self.e, self.n = c[by], s[by], p[by], e[by], n[by]
        self.ends = np.searchsorted(self.e, np.arange(1, self.width + 2))

    def forward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha[position, word part, language], arc weights). table: pieces x languages; its last row is the unknown's."""
        weight = table[self.p] * (LIFT ** self.n)[:, None]
        k = table.shape[1]
        alpha = np.zeros((self.width + 1, len(self.size), k))
        alpha[0] = 1
        for j in range(1, self.width + 1):
            a, b = self.ends[j - 1], self.ends[j]
            c = self.c[a:b]
            x = alpha[self.s[a:b], c] * weight[a:b]
            for lang in range(k):
                alpha[j, :, lang] = np.bincount(c, weights=x[:, lang], minlength=len(self.size))
        return alpha, weight

    def total(self, alpha: np.ndarray) -> np.ndarray:
        """The forward sum of each word part, in the order of its column, still lifted."""
        return alpha[self.size[self.rank], np.arange(len(self.size))]

    def scores(self, table: np.ndarray) -> np.ndarray:
        """log likelihood of each word: words x languages."""
        alpha, _ = self.forward(table)
        z = np.log(np.maximum(self.total(alpha), 1e-300)) - (self.size[self.rank] * np.log(LIFT))[:, None]
        out = np.zeros((self.n_words, table.shape[1]))
        out[self.owner[self.rank]] = z
        if self.long:
            logs = np.log(np.maximum(table, 1e-300))
            for k, w in self.long:
                out[k] = w.forward(logs)[-1]
        return out

    def expected(self, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language's words."""
        alpha, weight = self.forward(table)
        alpha, weight = alpha[:, :, 0], weight[:, 0]
        beta = np.zeros_like(alpha)
        last = self.size[self.rank]
        beta[last, np.arange(len(last))] = 1
        begins = np.argsort(-self.s, kind="stable")
        cut = np.searchsorted(-self.s[begins], -np.arange(self.width - 1, -2, -1))
        for k, j in enumerate(range(self.width - 1, -1, -1)):
            at = begins[cut[k] : cut[k + 1]]
            beta[j] += np.bincount(self.c[at], weights=weight[at] * beta[self.e[at], self.c[at]], minlength=len(last))
        z = np.maximum(alpha[last, np.arange(len(last))], 1e-300)
        gamma = alpha[self.s, self.c] * weight * beta[self.e, self.c] * (counts[self.owner[self.rank]] / z)[self.c]
        known = self.p >= 0
        out = np.bincount(self.p[known], weights=gamma[known], minlength=len(table) - 1)
        for k, w in self.long:
            out += counts[k] * w.expected(np.log(np.maximum(table, 1e-300)))
        return out


@dataclass
class Model:
    languages: list[str]
    vocab: Vocabulary
    table: np.ndarray  # pieces + 1 x languages
    prior: np.ndarray


def train_language(counts: Counter, vocab: Vocabulary, chunk: int = 20000) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation."""
    found = sorted(counts)
    n = np.array([counts[w] for w in found], float)
    size = len(vocab.hashes)
    p = np.append(np.full(size, 1 / size), UNKNOWN)
    for _ in range(ROUNDS):
        got = np.zeros(size)
        for i in range(0, len(found), chunk):
            got += Lattice(found[i : i + chunk], vocab).expected(p[:, None], n[i : i + chunk])
        total = got.sum()
        p = np.append((got + SMOOTH) / (total + SMOOTH * size), UNKNOWN)
    return p


def _words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").lower().split()]


def fit(docs: DataFrame, usable: Column, pieces: list[str], max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model | None:
    """Learn from rows that are usable and have a language and a text. None if there are none."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each, share = max(1, max_docs // len(sizes)), max_bytes // len(sizes)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30))
    rows = known.where(F.octet_length("text") <= share)

    def picked(shares: dict[str, float]) -> DataFrame:
        pick = F.lit(False)
        for lang, x in sorted(shares.items()):
            pick = pick | ((F.col("lang") == lang) & (draw < int(min(1.0, x) * (1 << 30))))
        return rows.where(pick)

    shares = {lang: min(1.0, each / n) for lang, n in sizes.items()}
    taken = {r[0]: r[1] for r in picked(shares).groupBy("lang").agg(F.sum(F.octet_length("text"))).collect()}
    shares = {lang: x * min(1.0, share / max(1, taken.get(lang) or 0)) for lang, x in shares.items()}
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found[lang].update(_words_of(text))
            triples = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            cols = list(zip(*triples, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    def train(t: pa.Table) -> pa.Table:
        counts = Counter(dict(zip(t.column("word").to_pylist(), t.column("n").to_pylist(), strict=True)))
        p = train_language(counts, Vocabulary.of(sent.value))
        return pa.table({"lang": t.column("lang").slice(0, 1), "p": pa.array([p.tobytes()], pa.binary())})

    counted = picked(shares).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    learned = {r[0]: np.frombuffer(bytes(r[1])) for r in counted.groupBy("lang").applyInArrow(train, "lang string, p binary").collect()}
    languages = sorted(learned)
    if not languages:
        return None
    n = np.array([sizes[x] for x in languages], float)
    return Model(languages, Vocabulary.of(pieces), np.stack([learned[x] for x in languages], 1), np.log(n / n.sum()))


class Scorer:
    """Scores whole texts; keeps the scores of words between calls."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(model.languages)), np.float32)

    def word_scores(self, keys: np.ndarray, first: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """keys: sorted distinct word hashes; first: a word for each."""
        at = np.searchsorted(self.keys, keys)
        have = np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(at, len(self.keys) - 1)
            have = self.keys[at] == keys
        out = np.empty((len(keys), len(self.model.languages)), np.float32)
        out[have] = self.values[at[have]]
        new = np.flatnonzero(~have)
        raw = data.tobytes()
        for i in range(0, len(new), 8192):
            k = first[new[i : i + 8192]]
            found = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]
            out[new[i : i + 8192]] = Lattice(found, self.model.vocab).scores(self.model.table)
        if len(self.keys) + len(new) > KEEP:
            self.keys, self.values = keys, out
        else:
            keys_all = np.concatenate([self.keys, keys[new]])
            order = np.argsort(keys_all, kind="stable")
            self.keys, self.values = keys_all[order], np.concatenate([self.values, out[new]])[order]
        return out

    def __call__(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        model = self.model
        data, offs = column_bytes(col)
        names, scores = [], []
        for i, j in chunks(offs):
            low = lower_ascii(data[offs[i] : offs[j]])
            o = offs[i : j + 1] - offs[i]
            starts, ends, h, per = words(low, o, NONSPACE)
            keys, first, which = np.unique(h, return_index=True, return_inverse=True)
            of = self.word_scores(keys, first, low, starts, ends)
            doc = np.repeat(np.arange(len(per)), per)
            total = np.stack([np.bincount(doc, weights=of[which, k], minlength=j - i) for k in range(len(model.languages))], 1) + model.prior
            top = total.argmax(1)
            posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            letter = np.append(0, np.cumsum((low >= 97) & (low <= 122)))
            plain = letter[o[1:]] > letter[o[:-1]]
            for d in range(j - i):
                if plain[d] or any(c.isalpha() for c in low[o[d] : o[d + 1]].tobytes().decode("utf-8", "replace")):
                    names.append(model.languages[top[d]])
                    scores.append(float(posterior[d]))
                else:
                    names.append(UNDETERMINED)
                    scores.append(1.0)
        return names, np.array(scores)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value) if sent.value else None
        for b in batches:
            names, s = score(b.column("text")) if score else ([UNDETERMINED] * b.num_rows, np.ones(b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(s, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
