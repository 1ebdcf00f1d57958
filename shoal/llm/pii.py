"""Personal data by aggregated weak supervision.

Base spans are found by the four fixed patterns of ``base_spans`` and always stay. Besides them, looser candidates are
collected (matches that failed a check, spelled-out addresses, phone numbers without a plus, shorter card numbers). Four
labelers vote on every candidate - pattern, gazetteer, context, shape - with yes, no or no opinion. Votes are counted over all
documents by their combination; expectation-maximisation estimates each labeler's reliability for each kind and the
posterior of each combination. On candidates of a bounded sample (``MAX_TRAIN``, drawn by a hash of text and place) a logistic
span classifier learns these posteriors from what the labelers do not see - the characters of the span, the words next to
it, where it stands - beside their votes, and decides which candidates join the base spans. Only the counted combinations (a few
thousand at most, whatever the corpus) and the sample reach the driver.

A null text is empty and has no spans. Offsets are code points. Whole texts and whole spans are searched; every step is linear in
the text's length, but for sorting the spans. Repeated rows are handled each on its own; extra columns pass through ``mask`` and
are ignored elsewhere. An empty table gives no rows, and without candidates nothing is learned. Of added candidates that
overlap another span of their kind the first one stays.
"""

from __future__ import annotations

import bisect
import copy
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, release_memory

KINDS = ("email", "ip", "card", "phone")
EM_ROUNDS = 60
PRIOR = 0.7
KEEP_AT = 0.5
PENALTY = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LONG_NUMBER = re.compile("[0-9]{13,19}")
_PHONE_HEAD = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])")
_DOT = re.compile(r"\s?(?:[\[(]dot[\])]|\sdot\s)\s?", re.IGNORECASE)
_SPELLED = re.compile(r"\s?(?:[\[(]at[\])]|\sat\s)\s?([A-Za-z0-9-]+(?:\s?(?:[\[(]dot[\])]|\sdot\s|\.)\s?[A-Za-z0-9-]+)+)", re.IGNORECASE)
_AT = re.compile(r"[\[(]at[\])]|\sat\s", re.IGNORECASE)
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:00[1-9][0-9 ().-]{6,18}[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])")

# Gazetteers and context words: plain public knowledge.
_TLDS = frozenset("com org net edu gov info io co de fr es uk eu us it nl ch at be pt se no dk fi pl ru cn jp in br mx ca au".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420")
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|4|5)|35")
_CONTEXT = {
    "email": re.compile(r"e-?mail|mailto|contact|write|adresse|correo|courriel"),
    "ip": re.compile(r"\bip\b|host|server|address|login|from"),
    "card": re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta|payment"),
    "phone": re.compile(r"tel|phone|call|mobile|fax|ruf|appel|llam"),
}
_AGAINST = re.compile(r"version|isbn|order|page|ref|sku|\bid\b|sha|token|password|release|\bv$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d += d if d < 5 else d - 9
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the local part cannot hold one."""
    out, end, p = [], 0, text.find("@")
    while p >= 0:
        s = p
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < p and (m := _DOMAIN.match(text, p + 1)):
            end = m.end()
            out.append((s, end))
            p = text.find("@", end)
        else:
            end = p + 1
            p = text.find("@", end)
    return out


def _ip_ok(s: str) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in s.split("."))


class _Spans:
    """Spans as disjoint intervals, to ask whether another one overlaps any of them."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of base spans and of everything that might join them, by kind and start."""
    found = [(0, s, e, True) for s, e in _emails(text)] if "@" in text else []
    for m in _AT.finditer(text):
        s = m.start()
        if s and m.group()[0] in "[(" and text[s - 1].isspace():
            s -= 1
        low = s
        while low and text[low - 1] in _LOCAL:
            low -= 1
        if low < s and (d := _SPELLED.match(text, s)) and (_DOT.search(d.group(1)) or m.group()[0] in "[("):
            found.append((0, low, d.end(), False))
    if _DIGIT.search(text):
        if "." in text:
            found += [(1, m.start(), m.end(), _ip_ok(m.group())) for m in _IP.finditer(text)]
        cards = []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                n = _only_digits(m.group())
                if len(n) >= 13:
                    base = 16 <= len(n) <= 19 and _luhn(n)
                    cards.append((2, m.start(), m.end(), base))
                    if not base and len(n) > 19:  # neighbouring numbers that ran into one match
                        cards += [(2, x.start(), x.end(), False) for x in _LONG_NUMBER.finditer(text, m.start(), m.end()) if _luhn(x.group())]
        found += cards
        phones = [(3, m.start(), m.end(), 8 <= len(_only_digits(m.group())) <= 15) for m in _PHONE.finditer(text)] if "+" in text else []
        for _, s, e, base in list(phones):
            if not base and (x := _PHONE_HEAD.match(text, s, e)):  # a number that ran into the next one
                head = x.group()
                while len(_only_digits(head)) > 12:
                    head = re.sub("[ .-]?[0-9]+$", "", head)
                if 8 <= len(_only_digits(head)) and head[-1:].isdigit():
                    phones.append((3, s, s + len(head), False))
        taken = _Spans((s, e) for _, s, e, _ in [*cards, *phones])
        found += phones
        found += [(3, m.start(), m.end(), False) for m in _LOOSE_PHONE.finditer(text) if not taken.meets(m.start(), m.end())]
    return sorted(found)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    return [c[:3] for c in candidates(text or "") if c[3]]


def votes(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """The four labelers' votes (0 no opinion, 1 yes, 2 no) and the span's length class, as one number."""
    s = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    name = KINDS[kind]
    pattern = 1 if base else 0
    gazetteer = shape = 0
    digits = _only_digits(s)
    if name == "email":
        gazetteer = 1 if re.split(r"[.\s)\]]+", s.rstrip(".-").lower())[-1] in _TLDS else 2
        shape = 1 if base and len(s) <= 80 else 0
    elif name == "ip":
        pattern = 1 if base else 2
        first = s.split(".")[0]
        gazetteer = 1 if len(first) <= 3 and 0 < int(first) < 224 else 2
        shape = 2 if any(len(p) > 3 or (len(p) > 1 and p[0] == "0") for p in s.split(".")) else 1
    elif name == "card":
        valid = _luhn(digits)
        pattern = 1 if base else (0 if valid else 2)
        gazetteer = 1 if _ISSUER.match(digits) else 2
        shape = 1 if len(digits) in (15, 16) else 2 if len(digits) > 19 else 0
    else:
        pattern = 1 if base else (2 if s.startswith("+") and not 8 <= len(digits) <= 15 else 0)
        gazetteer = 1 if s.startswith("+") and digits.startswith(_CALLING) else 0
        shape = 1 if 9 <= len(digits) <= 13 else 2
    context = 1 if _CONTEXT[name].search(before) else 2 if _AGAINST.search(before) else 0
    near = (text[start - 1 : start] + text[end : end + 1])
    if any(c.isalnum() for c in near):
        shape = 2
    size = min(3, (end - start) // 12)
    return (((pattern * 3 + gazetteer) * 3 + context) * 3 + shape) * 4 + size


N_VOTES = 81 * 4


def _split(code: np.ndarray) -> np.ndarray:
    """Codes to (votes of the four labelers, length class)."""
    v = code // 4
    return np.stack([v // 27, v // 9 % 3, v // 3 % 3, v % 3, code % 4], 1)


def em(kind: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Posterior of each (kind, votes) combination from the labelers' agreement alone (Dawid and Skene)."""
    v = _split(code)[:, :4]
    yes, no = (v == 1).sum(1), (v == 2).sum(1)
    post = (PRIOR + yes) / (1 + yes + no)
    for _ in range(EM_ROUNDS):
        new = post.copy()
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            p, w = post[at], n[at]
            prior = (w @ p + 2 * PRIOR) / (w.sum() + 2)
            odds = np.log(prior / (1 - prior)) * np.ones(len(at))
            for labeler in range(4):
                t, f = np.ones(3), np.ones(3)
                if labeler == 0:  # the pattern labeler is better than chance
                    t, f = np.array([1.0, 8.0, 1.0]), np.array([1.0, 1.0, 8.0])
                np.add.at(t, v[at, labeler], w * p)
                np.add.at(f, v[at, labeler], w * (1 - p))
                odds += np.log(t / t.sum())[v[at, labeler]] - np.log(f / f.sum())[v[at, labeler]]
            new[at] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post


#: Candidates that the classifier learns from, at most; hash buckets of the words beside a span.
MAX_TRAIN = 20_000
WORDS = 32
_LAST_WORD = re.compile(r"[^\W\d_]+(?=[\W\d_]*$)")
_NEXT_WORD = re.compile(r"[\W\d_]*([^\W\d_]+)")
N_SPAN = 9


def span_features(text: str, start: int, end: int) -> tuple[int, ...]:
    """What no labeler looks at: hashes of the words on either side (WORDS: none), shares of digits, letters and separators
    in tenths, different digits, groups, where the span stands in its text in quarters, and its length in eighths of its logarithm."""
    s = text[start:end]
    before, after = _LAST_WORD.search(text, max(0, start - 40), start), _NEXT_WORD.match(text, end, end + 40)
    word = lambda w: zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
    digits = sum(map(s.count, "0123456789"))
    letters = sum(map(str.isalpha, s))
    n = len(s)
    return (
        word(before.group()) if before else WORDS,
        word(after.group(1)) if after else WORDS,
        10 * digits // n,
        10 * letters // n,
        10 * (n - digits - letters) // n,
        sum(c in s for c in "0123456789"),
        min(9, len(re.findall("[0-9]+", s))),
        4 * start // max(1, len(text)),
        min(31, int(8 * math.log2(n))) // 2,
    )


def _design(kind: np.ndarray, code: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Rows of the classifier: votes and length class by kind, span features by kind, words on either side."""
    v = _split(code)
    cols = [np.ones(len(code))]
    for k in range(len(KINDS)):
        mine = kind == k
        cols.append(mine)
        for labeler in range(4):
            cols += [mine & (v[:, labeler] == 1), mine & (v[:, labeler] == 2)]
        cols += [mine & (v[:, 4] == s) for s in range(1, 4)]
        cols += [mine * (spans[:, f] / 10) for f in range(2, N_SPAN)]
    for side in (0, 1):
        cols += [spans[:, side] == w for w in range(WORDS + 1)]
    return np.stack(cols, 1).astype(float)


def train_classifier(kind: np.ndarray, code: np.ndarray, spans: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the posteriors, by Newton steps with a small penalty."""
    x = _design(kind, code, spans)
    b = np.zeros(x.shape[1])
    for _ in range(25 if len(kind) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(b))
        move = np.linalg.solve(h, x.T @ (p - post) + PENALTY * b)
        b -= move
        if np.abs(move).max() < 1e-8:
            break
    return b


def probability(model: np.ndarray, kind: np.ndarray, code: np.ndarray, spans: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(kind, code, spans) @ model, -30, 30)))


CANDIDATE_SCHEMA = "doc_id long, kinds array<int>, starts array<int>, ends array<int>, bases array<boolean>, codes array<int>, features array<int>"


def _described(text: str) -> list[tuple]:
    """(kind, start, end, base, votes, span features) of each candidate."""
    return [(*c, votes(text, *c), span_features(text, c[1], c[2])) for c in candidates(text)]


def find_candidates(docs: DataFrame) -> DataFrame:
    """Every document with its candidates, their votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column("text"):
                c = _described(x.as_py() or "")
                rows.append((*([y[i] for y in c] for i in range(5)), [z for y in c for z in y[5]]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32()] * 3 + [pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.list_(t)) for c, t in zip(cols, kinds, strict=True))], names=[c.split()[0] for c in CANDIDATE_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CANDIDATE_SCHEMA)


def _model(counted: list[tuple[int, int, int]], drawn: list[tuple]) -> np.ndarray:
    """The classifier from the counts of all combinations, and rows (kind, votes, features) of the sample."""
    if not counted:
        return train_classifier(*(np.zeros(0, np.int64),) * 2, np.zeros((0, N_SPAN)), np.zeros(0))
    kind, code, n = (np.array([r[i] for r in counted], np.int64) for i in range(3))
    post = dict(zip(zip(kind.tolist(), code.tolist(), strict=True), em(kind, code, n.astype(float)).tolist(), strict=True))
    k, c = (np.array([r[i] for r in drawn], np.int64) for i in range(2))
    return train_classifier(k, c, np.array([r[2] for r in drawn], float).reshape(-1, N_SPAN), np.array([post[a, b] for a, b in zip(k.tolist(), c.tolist(), strict=True)]))


def _fit(rows: DataFrame) -> np.ndarray:
    """From rows (kind, code, features), one a candidate or with n a number of equal ones."""
    counted = sorted(tuple(r) for r in rows.groupBy("kind", "code").agg(F.sum("n")).collect())
    total = sum(r[2] for r in counted)
    share = min(1.0, MAX_TRAIN / max(1, total))
    drawn = rows.where(F.col("draw") < share).select("kind", "code", "features").limit(2 * MAX_TRAIN).collect()
    return _model(counted, sorted((r[0], r[1], list(r[2])) for r in drawn))


def _draw(*parts) -> F.Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def fit(found: DataFrame) -> np.ndarray:
    """The classifier, from the votes on the candidates of all documents."""
    both = found.select("doc_id", "features", F.posexplode(F.arrays_zip("kinds", "codes", "starts", "ends")).alias("at", "c"))
    mine = F.slice("features", F.col("at") * N_SPAN + 1, N_SPAN)
    return _fit(both.select(F.col("c.kinds").alias("kind"), F.col("c.codes").alias("code"), F.lit(1).alias("n"), mine.alias("features"), _draw("doc_id", "c.starts", "c.ends").alias("draw")))


def fit_on(docs: DataFrame) -> np.ndarray:
    """The same from texts, by a stored table of their candidates' votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, v, list(f), s, e, len(text)) for x in b.column("text") for text in [x.as_py() or ""] for k, s, e, _, v, f in _described(text)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "code", "features", "s", "e", "size"])

    rows = materialise(docs.select("text").mapInArrow(run, "kind int, code int, features array<int>, s int, e int, size int"), "pii-votes")
    return _fit(rows.select("kind", "code", F.lit(1).alias("n"), "features", _draw("features", "s", "e", "size").alias("draw")))


def chosen(found: list[tuple], model: np.ndarray) -> list[tuple[int, int, int]]:
    """Base spans and the candidates (kind, start, end, base, votes, features) that the classifier keeps; these never overlap
    another span of their kind."""
    out = [x[:3] for x in found if x[3]]
    loose = [x for x in found if not x[3]]
    if loose:
        p = probability(model, np.array([x[0] for x in loose]), np.array([x[4] for x in loose]), np.array([x[5] for x in loose], float))
        taken = [_Spans((s, e) for a, s, e in out if a == k) for k in range(len(KINDS))]
        last = [-1] * len(KINDS)
        for (k, s, e, *_), q in zip(loose, p.tolist(), strict=True):  # by kind and start
            if q >= KEEP_AT and s >= last[k] and not taken[k].meets(s, e):
                out.append((k, s, e))
                last[k] = e
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


SPAN_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def spans(found: DataFrame, model: np.ndarray) -> DataFrame:
    """Per document: the numbers of base spans, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
        for b in batches:
            rows = []
            for r in b.select(["kinds", "starts", "ends", "bases", "codes", "features"]).to_pylist():
                if not r["kinds"]:
                    rows.append(nothing)
                    continue
                f = r.pop("features")
                c = list(zip(*r.values(), [f[i : i + N_SPAN] for i in range(0, len(f), N_SPAN)], strict=True))
                base = [x[:3] for x in c if x[3]]
                n = Counter(k for k, *_ in base)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(written(base).encode()).hexdigest(), written(chosen(c, model))))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in cols[:4]), *(pa.array(x, pa.string()) for x in cols[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(run, SPAN_SCHEMA)


def detect(docs: DataFrame) -> DataFrame:
    found = materialise(find_candidates(docs), "pii-candidates")
    return spans(found, fit(found))


def masked(text: str, model: np.ndarray) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    c = _described(text)
    if not c:
        return text
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in chosen(c, model)):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """docs with personal data replaced in text (nulls stay null), and n_chars, if there, set to the new length."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [masked(t, model) if t else t for t in b.column("text").to_pylist()]
            new = {"text": pa.array(texts, b.schema.field("text").type)}
            if "n_chars" in names:
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, b.column("n_chars").to_pylist(), strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names=names)
            release_memory()

    return docs.mapInArrow(run, T.StructType(copy.deepcopy(docs.schema.fields)))
