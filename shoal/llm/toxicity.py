"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear model over hashed word features is trained with numpy by stochastic gradient steps on the class-prior-corrected
risk of Kiryo et al. (2017): pi * R_p^+ + max(0, R_u^- - pi * R_p^-). Positives are the confirmed toxic rows; the unlabelled
rows are drawn from all rows that training may see, whatever their labels say. Training is done at the driver on a bounded
sample (``MAX_POSITIVE``, ``MAX_UNLABELLED``, ``MAX_TRAIN_BYTES``); every document is scored, in whole.

Features are the distinct words of a text (A-Z lower-cased, letters, digits and non-ASCII) and their first 4, 5 and 6 bytes,
hashed to 2**BITS. Training takes those that stand in more positives than chance explains (a wide choice, several thousand) and
learns their weights from zero. The threshold is set on texts that were held back from training, and a text's score is a sigmoid
of its summed weights around it.

Null and empty texts have no features and get the score of the bias. Very long texts are scored whole, a text at a time. Repeated
rows are scored alike (in training they count once in each class); ties at the threshold are positive. Extra columns pass through.
With no toxic row to learn from, or an empty table of documents, all scores are 0. Rows without an id are scored, not learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, chunks, column_bytes, lower_ascii, release_memory, word_features

BITS = 22
#: Bytes of word beginnings that are features.
PREFIXES = (4, 5, 6)
#: Bounds of the training sample.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
MAX_TRAIN_BYTES = 64 << 20
STEPS = 300
#: One in so many texts is held back from training, to set the threshold by.
HELD_BACK = 5
RATE = 0.05
DECAY = 1e-3
THRESHOLD = 0.7
#: A feature must stand in as many positives, at as many standard deviations above chance, with such a precision.
MIN_TEXTS = 4
MIN_DEVIATIONS = 2.5
MIN_PRECISION = 0.05


@dataclass
class Model:
    """The features that have a weight, ascending, and their weights; the sigmoid's scale and offset."""

    known: np.ndarray
    weights: np.ndarray
    scale: float
    offset: float

    def scores(self, col: pa.Array) -> np.ndarray:
        data, offs = column_bytes(col)
        known = np.zeros(1 << BITS, bool)
        known[self.known] = True
        out = [np.zeros(0)]
        for i, j in chunks(offs):
            doc, feat = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], known)
            raw = np.bincount(doc, weights=self.weights[np.searchsorted(self.known, feat)], minlength=j - i)
            out.append(1 / (1 + np.exp(-np.clip(self.scale * raw + self.offset, -40, 40))))
        return np.concatenate(out)


def features(data: np.ndarray, offs: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once; known: a mask of the features to keep."""
    per, hashes = word_features(lower_ascii(data), offs, ALNUM, PREFIXES)
    doc = np.repeat(np.arange(len(per)), per)
    pairs = []
    for has, h in hashes:
        feat = (h >> np.uint64(64 - BITS)).astype(np.int64)
        owner = doc if has is None else doc[has]
        if known is not None:
            keep = np.flatnonzero(known[feat])
            owner, feat = owner[keep], feat[keep]
        pairs.append((owner << BITS) | feat)
    pair = np.unique(np.concatenate(pairs))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def sample(docs: DataFrame, labels: DataFrame, usable) -> tuple[list[tuple[str, bool]], float]:
    """Bounded training texts with whether they are confirmed positives, and the class prior.

    usable: a condition on doc_id for the rows that may be learned from. The prior is the share of toxic rows among all
    usable labelled rows. The hash of doc_id decides who is drawn, so the sample is the same in every run."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", "toxic")
    n_known, n_pos = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    n_docs = docs.where(usable).count()
    if not n_pos or not n_docs:
        return [], 0.0
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    most = [min(1.0, MAX_POSITIVE / n_pos), min(1.0, MAX_UNLABELLED / n_docs)]
    picked = lambda share: draw < int(share * (1 << 30))
    ids = known.where((F.col("toxic") == 1) & picked(most[0])).select("doc_id").distinct()
    of_ids = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    budget = MAX_TRAIN_BYTES // 2  # each class has its own, so neither can crowd the other out
    out = []
    for rows, share, pos in ((of_ids, most[0], True), (docs.where(usable & F.col("doc_id").isNotNull()), most[1], False)):
        rows = rows.where(picked(share) & (F.octet_length("text") <= budget))
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        rows = rows.where(picked(share * min(1.0, 0.95 * budget / max(1, size)))).select("text")  # a partition at a time, and seldom cut off
        left = budget
        for (text,) in rows.toLocalIterator():
            n = len(text.encode("utf-8", "surrogatepass"))
            if n <= left:
                left -= n
                out.append((text, pos))
    return out, n_pos / n_known


def _select(rows: list[tuple[str, bool]], pos: np.ndarray, prior: float) -> np.ndarray:
    """A mask of the features that are worth a weight."""
    df = np.zeros((2, 1 << BITS), np.int32)
    for i in range(0, len(rows), 128):
        d, f = features(*column_bytes(pa.array([t for t, _ in rows[i : i + 128]], pa.large_string())))
        isp = pos[i : i + 128][d]
        df[0] += np.bincount(f[isp], minlength=1 << BITS).astype(np.int32)
        df[1] += np.bincount(f[~isp], minlength=1 << BITS).astype(np.int32)
    n_p, n_u = int(pos.sum()), int((~pos).sum())
    at = np.flatnonzero(df[0] >= min(MIN_TEXTS, max(2, n_p // 4)))
    share, rest = df[0][at] / n_p, (df[1][at] + 0.5) / n_u
    mean = (df[0][at] + df[1][at]) / (n_p + n_u)
    dev = (share - rest) / np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u) + 1e-12)
    good = at[(dev >= MIN_DEVIATIONS) & (prior * share / rest >= MIN_PRECISION)]
    mask = np.zeros(1 << BITS, bool)
    mask[good] = True
    return mask


def _matrix(rows: list[tuple[str, bool]], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number) pairs of the features of a mask."""
    number = np.cumsum(mask) - 1
    doc, feat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(rows), 256):
        d, f = features(*column_bytes(pa.array([t for t, _ in rows[i : i + 256]], pa.large_string())), mask)
        doc.append(d + i)
        feat.append(number[f])
    return np.concatenate(doc), np.concatenate(feat)


def nnpu(doc: np.ndarray, feat: np.ndarray, pos: np.ndarray, k: int, prior: float, steps: int | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias from zero weights by full-batch steps on the non-negative risk with the sigmoid loss."""
    n_p, n_u = int(pos.sum()), int((~pos).sum())
    v, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, (STEPS if steps is None else steps) + 1):
        z = np.bincount(doc, weights=v[feat], minlength=len(pos)) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = s * (1 - s)
        # the sigmoid loss of label +1 is 1 - s, that of label -1 is s
        if s[~pos].mean() - prior * s[pos].mean() >= 0:
            g = np.where(pos, -2 * prior * slope / n_p, slope / n_u)
        else:  # the estimate of the negative part went below zero: step back
            g = np.where(pos, prior * slope / n_p, -slope / n_u)
        grad = np.append(np.bincount(feat, weights=g[doc], minlength=k) + DECAY / max(1, k) * v, g.sum())
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad**2 - square)
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        v -= move[:-1]
        bias -= move[-1]
    return v, bias


def train(rows: list[tuple[str, bool]], prior: float, steps: int | None = None) -> Model:
    """nnPU on four fifths of the rows, the threshold on the others (split by the text). The unlabelled rows keep whatever
    positives they hold, as the risk estimate asks; copies count once within each class."""
    rows = list(dict.fromkeys(rows))
    if not any(p for _, p in rows) or all(p for _, p in rows):
        return Model(np.zeros(0, np.int64), np.zeros(0), 1.0, -40.0)
    back = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % HELD_BACK == 0 for t, _ in rows])
    pos = np.array([p for _, p in rows], bool)
    if min(pos[back].sum(), (~pos[back]).sum(), pos[~back].sum(), (~pos[~back]).sum()) < 4:  # too few to hold any back
        learn = judge = np.arange(len(rows))
    else:
        learn, judge = np.flatnonzero(~back), np.flatnonzero(back)
    prior = min(max(prior, 1e-4), 0.5)
    taught = [rows[i] for i in learn]
    mask = _select(taught, pos[learn], prior)
    v, _ = nnpu(*_matrix(taught, mask), pos[learn], int(mask.sum()), prior, steps)
    doc, feat = _matrix([rows[i] for i in judge], mask)
    return calibrate(np.flatnonzero(mask), v, np.bincount(doc, weights=v[feat], minlength=len(judge)), pos[judge], prior)


def calibrate(known: np.ndarray, v: np.ndarray, z: np.ndarray, pos: np.ndarray, prior: float) -> Model:
    """Put the threshold where recall less the prior-corrected false alarms is best, and scale the sigmoid around it."""
    zp, zu = np.sort(z[pos]), np.sort(z[~pos])
    best, at = -np.inf, float(zp[-1])
    for t in np.unique(zp[zp > 0]):
        tpr = 1 - np.searchsorted(zp, t) / len(zp)
        fpr = max(0.0, 1 - np.searchsorted(zu, t) / len(zu) - prior * tpr) / (1 - prior)
        if tpr - 5 * fpr > best:
            best, at = tpr - 5 * fpr, float(t)
    below = max(0.0, float(zu[zu < at].max(initial=0.0)))
    cut = (at + below) / 2
    spread = max(1e-3, float(np.median(zp)) - cut)
    scale = 3.0 / spread
    return Model(known, v, scale, float(np.log(THRESHOLD / (1 - THRESHOLD))) - scale * cut)


def fit(docs: DataFrame, labels: DataFrame, usable) -> Model:
    return train(*sample(docs, labels, usable))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 added; all other columns pass through."""
    import copy

    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*copy.deepcopy(docs.schema.fields), T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, column])
            release_memory()

    return docs.mapInArrow(run, schema)
