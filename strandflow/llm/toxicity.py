"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Training takes a bounded sample of labelled rows (``per_class`` of each label,
texts of at most ``most_bytes``). Half of it gives the lexicon (words and word
beginnings that are commoner under label 1, weighted by log odds), a quarter the
trees, and a quarter the calibration. Features of whole texts: lexicon hits,
their density, weight and variety, second-person words near hits, capitals,
punctuation, obfuscated words, length.

Letters, capitals and punctuation are those of all scripts; words are compared in
lower case. A token is obfuscated if a mask (``*#$%&@`` or a digit that stands for a
letter) has letters before and after it, unless it is an address or a path.

Empty and null texts get the score of a text without any feature. With labels of
one kind only, every score is 1 or 0 as that label says; with none it is 0, for
lack of evidence. Rows without doc_id are scored; repeated rows get equal scores;
an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import codepoints
from strandflow.llm import textkernels as K
from strandflow.llm.boosting import BoostedTrees, Isotonic, sigmoid
from strandflow.llm.tables import held_out, labelled_sample

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
PREFIXES = (3, 4, 5, 6, 7)
#: Log odds from which an entry counts as a hit.
STRONG = 3.0
N_FEATURES = 13
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre usted ustedes tú ti".split()
NEAR = 4
#: Kinds of code points: blanks, small letters and letters without case, capitals, the rest, digits that stand for letters; from MASK on, punctuation.
BLANK, SMALL, CAPITAL, OTHER, DIGIT, MASK, AT, DOT, SLASH, SHOUT, PUNCTUATION = range(11)
_FIXED = {**dict.fromkeys(" \t\n\r\x0b\x0c", BLANK), **dict.fromkeys("013457", DIGIT), **dict.fromkeys("*#$%&", MASK), "@": AT, ".": DOT, "/": SLASH, **dict.fromkeys("!?\u00a1\u00bf\uff01\uff1f", SHOUT)}
_ANY_LETTER = K.byte_table(lambda b: b != 32)
_TOKEN = K.byte_table(lambda b: b != BLANK)


def _kind(c: str) -> int:
    if c in _FIXED:
        return _FIXED[c]
    if c.isalpha():
        return CAPITAL if c.isupper() else SMALL
    return PUNCTUATION if unicodedata.category(c)[0] in "PS" else OTHER


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """Kinds of the code points of a piece, offsets of its documents in them, and its words: runs of letters, in lower case."""
    points, first = codepoints.read(data, at)
    kinds = codepoints.look_up(codepoints.table(_kind, "uint8"), points)
    letters = (kinds == SMALL) | (kinds == CAPITAL)
    folded = np.where(letters, codepoints.fold(points), 32).astype("<u4")
    size = 1 + (folded > 0x7F) + (folded > 0x7FF) + (folded > 0xFFFF)
    raw = np.frombuffer(folded.tobytes().decode("utf-32-le").encode(), np.uint8)
    return kinds, first, K.words(raw, np.concatenate([[0], np.cumsum(size)])[first], _ANY_LETTER)


def _keys(words: K.Words) -> list[np.ndarray]:
    """Codes of each word: the whole, and its beginnings by length; kinds don't meet."""
    long = words.ends - words.starts
    return [words.hashes(), *(np.where(long >= n, K.mix(words.prefixes(n) + np.uint64(n << 56)), np.uint64(0)) for n in PREFIXES)]


def _per_document(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[first])


@dataclass
class Lexicon:
    """Codes, ascending, and their log odds for label 1."""

    codes: np.ndarray
    weights: np.ndarray


def features(data: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Documents by features."""
    kinds, first, words = _lines(data, at)
    n = np.maximum(words.counts(), 1)
    size = np.maximum(np.diff(first), 1)
    keys = _keys(words)
    entry, weight = np.full(len(words.starts), -1), np.zeros(len(words.starts))
    for k in keys:
        found = K.in_sorted(k, lexicon.codes)
        own = np.where(found >= 0, lexicon.weights[found] if len(lexicon.codes) else 0.0, 0.0)
        entry = np.where(own > weight, found, entry)
        weight = np.maximum(weight, own)
    hit = weight >= STRONG
    person = K.in_sorted(keys[0], _second_person()) >= 0
    doc = words.docs()
    near = np.zeros(len(hit), bool)
    for step in range(1, NEAR + 1):
        same = doc[step:] == doc[:-step]
        near[step:] |= person[:-step] & same
        near[:-step] |= person[step:] & same
    hits = _per_document(hit, words.first)
    entries = len(lexicon.codes) + 1
    variety = np.bincount(np.unique(doc[hit] * entries + entry[hit]) // entries, minlength=len(n))
    some = np.flatnonzero(words.counts())
    most = np.zeros(len(n))
    if len(some):
        most[some] = np.maximum.reduceat(weight, words.first[:-1][some])
    summed = np.diff(np.concatenate([[0], np.cumsum(weight)])[words.first])
    tokens = K.words(kinds, first, _TOKEN)
    where = [np.concatenate([[0], np.cumsum(m)]) for m in ((kinds == MASK) | (kinds == DIGIT), kinds == AT, kinds == DOT, kinds == SLASH)]
    _, ats, dots, slashes = (w[tokens.ends] - w[tokens.starts] for w in where)
    # masks between the first and the last letter of the token
    letter = np.flatnonzero((kinds == SMALL) | (kinds == CAPITAL))
    lo, hi = np.searchsorted(letter, tokens.starts), np.searchsorted(letter, tokens.ends) - 1
    some = hi > lo
    between = np.zeros(len(lo), np.int64)
    for w in where[:2]:
        between[some] += w[letter[hi[some]]] - w[letter[lo[some]]]
    masked = (between > 0) & (slashes == 0) & ~((ats > 0) & (dots > 0))
    obfuscated = _per_document(masked, tokens.first)
    shares = (kinds == CAPITAL, kinds >= MASK, kinds == SHOUT)
    return np.column_stack(
        [hits, hits / n, variety, summed / n, summed, most, _per_document(hit & near, words.first), _per_document(person, words.first) / n]
        + [_per_document(m, first) / size for m in shares]
        + [obfuscated / np.maximum(tokens.counts(), 1), np.log1p(words.counts())]
    ).astype(float)


_PERSON: list[np.ndarray] = []


def _second_person() -> np.ndarray:
    if not _PERSON:
        _PERSON.append(np.unique(_lines(*K.string_bytes(pa.array(SECOND_PERSON)))[2].hashes()))
    return _PERSON[0]


def learn_lexicon(texts: list[str], y: np.ndarray, least: float, odds: float, deviations: float, most: int) -> Lexicon:
    """Codes in at least ``least`` of the texts of label 1 whose log odds are ``odds`` or more, by so many standard deviations."""
    with_1, with_0 = Counter(), Counter()
    for lo, hi, data, at in K.pieces(pa.array(texts, pa.string())):
        words = _lines(data, at)[2]
        keys = _keys(words)
        for d in range(hi - lo):
            own = np.unique(np.concatenate([k[words.first[d] : words.first[d + 1]] for k in keys]))
            (with_1 if y[lo + d] else with_0).update(own[own != 0].tolist())
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    found = []
    for k, a in with_1.items():
        b = with_0[k]
        if a >= max(3, least * n1):
            p, q, all_of = a / n1, b / n0, (a + b) / (n1 + n0)
            z = (p - q) / np.sqrt(max(all_of * (1 - all_of), 1e-9) * (1 / n1 + 1 / n0))
            weight = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
            if z >= deviations and weight >= odds:
                found.append((z, k, weight))
    found = sorted(sorted(found, reverse=True)[:most], key=lambda f: f[1])
    return Lexicon(np.array([k for _, k, _ in found], np.uint64), np.array([w for _, _, w in found]))


class Model:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, calibrated: Isotonic | None, share: float = 0.0):
        self.lexicon, self.trees, self.calibrated, self.share = lexicon, trees, calibrated, share

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(at) - 1, self.share)
        raw = self.trees.raw(features(data, at, self.lexicon))
        return np.clip(self.calibrated(raw) + 1e-9 * sigmoid(raw), 0, 1)


def _features_of(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    parts = [features(data, at, lexicon) for _, _, data, at in K.pieces(pa.array(texts, pa.string()))]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def train(rows: list[tuple[str, int]], least: float = 0.01, odds: float = 1.0, deviations: float = 4.0, most: int = 2000) -> Model:
    """``rows``: (text, label)."""
    y = np.array([label for _, label in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, float(y.mean()) if len(y) else 0.0)
    turn = np.arange(len(rows)) % 4
    part = lambda *k: [t for (t, _), j in zip(rows, turn, strict=True) if j in k]
    lexicon = learn_lexicon(part(0, 1), y[turn < 2], least, odds, deviations, most)
    trees = BoostedTrees().fit(_features_of(part(2), lexicon), y[turn == 2])
    return Model(lexicon, trees, Isotonic().fit(trees.raw(_features_of(part(3), lexicon)), y[turn == 3]))


def _scorer(shared, column: str):
    @K.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, at in K.pieces(batch.column(column)):
                out[lo:hi] = model.score(data, at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i, name in enumerate(batch.schema.names) if name != column), pa.array(out)],
                [*(name for name in batch.schema.names if name != column), "score"],
            )

    return score


def train_from(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_bytes: int = 1 << 15) -> Model:
    return train(labelled_sample(docs, labels, "toxic", 5, 0, per_class, most_bytes))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_bytes: int = 1 << 15, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train_from(docs, labels, per_class, most_bytes))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), "text").mapInArrow(_scorer(shared, "text"), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keeper(shared, threshold: float):
    @K.tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for lo, hi, data, at in K.pieces(batch.column("text")):
                stay[lo:hi] = model.score(data, at) < threshold
            yield batch.filter(pa.array(stay))

    return keep


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_bytes: int = 1 << 15, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train_from(docs, labels, per_class, most_bytes))
    return docs.mapInArrow(_keeper(shared, threshold), docs.schema)
