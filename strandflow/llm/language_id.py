"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are those of all training rows, whole texts, summed by Spark from each
task's matrix; the smoothed log-probability matrix (2**bits buckets by languages) is
broadcast. A batch is scored as a sparse sum: one gather per n-gram, summed by
document. All cased letters are folded. The prior is uniform: how many rows a
language has says nothing about the next text.

A text that is null or has no letter is ``und`` with score 0, as is every text when
no language was learned. The score is the posterior probability of the answer,
with the evidence of long texts scaled down to ``evidence`` n-grams so that it stays
graded. Rows without doc_id train and are scored like others; repeated rows count
each time; an empty table gives no rows. More than ``most_languages`` languages, which
bounds the matrix, are an error; none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import textkernels as K
from strandflow.llm.codepoints import fold, is_letter, look_up, read, table
from strandflow.llm.tables import held_out, materialize

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def grams(points: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram that starts at each code point) for each order."""
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(orders) + 1):
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + (points[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n in orders and len(h):
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield n, x >> np.uint32(32 - bits)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, orders: tuple[int, ...], bits: int, evidence: int):
        self.languages, self.weights, self.orders, self.bits, self.evidence = languages, weights, orders, bits, evidence

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Answer and score of each document of a piece."""
        raw, first = read(data, at)
        points = fold(raw)
        n_docs, k = len(first) - 1, len(self.languages)
        total, seen = np.zeros((n_docs, k)), np.zeros(n_docs)
        for n, bucket in grams(points, self.orders, self.bits):
            lo, hi = np.minimum(first[:-1], len(bucket)), np.minimum(np.maximum(first[1:] - n + 1, first[:-1]), len(bucket))
            some = np.flatnonzero(hi > lo)
            if len(some):
                edges = np.stack([lo[some], hi[some]], 1).ravel()
                edges = edges[:-1] if edges[-1] == len(bucket) else edges
                for j in range(k):
                    total[some, j] += np.add.reduceat(self.weights[j][bucket], edges)[::2]
                seen[some] += (hi - lo)[some]
        letters = np.concatenate([[0], np.cumsum(look_up(table(is_letter), raw))])[first]
        has = np.diff(letters) > 0
        if not k:
            return ["und"] * n_docs, np.zeros(n_docs)
        total *= np.minimum(1, self.evidence / np.maximum(seen, 1))[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, p[np.arange(n_docs), best], 0.0)


def _counts(orders: tuple[int, ...], bits: int, most: int = 64):
    """(language, bucket, n): n-grams inside documents; a task holds the matrix of at most ``most`` languages, and one of a piece."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def found() -> Iterator[pa.RecordBatch]:
            for language, counts in held.items():
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "bucket", "n"])

        for batch in batches:
            for lo, hi, data, at in K.pieces(batch.column("text")):
                names, code = np.unique(np.array(batch.column("lang").slice(lo, hi - lo).to_pylist(), object), return_inverse=True)
                points, first = read(data, at)
                points = fold(points)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                for n, bucket in grams(points, orders, bits):
                    inside = doc[: len(bucket)] == doc[n - 1 :]
                    owner, bucket = code[doc[: len(bucket)][inside]], bucket[inside]
                    for i, language in enumerate(names):
                        mine = bucket if len(names) == 1 else bucket[owner == i]
                        if len(mine):
                            counts = np.bincount(mine, minlength=1 << bits)
                            held[language] = held[language] + counts if language in held else counts
                if len(held) > most:
                    yield from found()
                    held.clear()
        yield from found()

    return emit


def train(docs: DataFrame, orders: tuple[int, ...], bits: int, alpha: float, evidence: int, most_languages: int) -> Model:
    """Learns from all rows of ``docs`` (text, lang), neither of them null."""
    found = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_counts(orders, bits), "lang string, bucket int, n long")
    found = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = materialize(found)
    languages = sorted(r[0] for r in found.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts = np.zeros((len(languages), 1 << bits))
    rows = found.toArrow()
    at = {language: i for i, language in enumerate(languages)}
    counts[np.array([at[x] for x in rows.column("lang").to_pylist()], np.int64), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    weights = np.log(counts + alpha) - np.log((counts + alpha).sum(1, keepdims=True)) if languages else counts
    return Model(languages, weights.astype(np.float32), orders, bits, evidence)


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            answers: list[str] = []
            scores = np.zeros(batch.num_rows)
            for lo, hi, data, at in K.pieces(batch.column("text"), 1 << 20):
                found, scores[lo:hi] = model.score(data, at)
                answers += found
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(answers, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify_language(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 14, alpha: float = 0.5, evidence: int = 60, most_languages: int = 512) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the predicted language and its score."""
    known = docs.where(~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(train(known, orders, bits, alpha, evidence, most_languages))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), "text").mapInArrow(_predictor(shared), SCHEMA)
