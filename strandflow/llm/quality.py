"""Quality by compression: zstandard dictionaries of good and of bad text.

A bounded sample of labelled rows (``per_class`` of each label, texts of at
most ``most_bytes``) is cut into blocks; one dictionary is trained on the good
blocks of a third of it, one on the bad. A text is compressed block by block
against both, and the normalised size difference (bad - good) / (bad + good) of
the whole text, and nothing else, becomes the score: an isotonic fit on the rows
that the dictionaries have not seen calibrates it, and a logistic curve of it,
with a thousandth of the weight, keeps texts apart that share a step.

Empty and null texts are scored as a text of no difference. With one label only
or none, every score is that label's share, 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import textkernels as K
from strandflow.llm.boosting import Isotonic, logistic, sigmoid
from strandflow.llm.tables import held_out, labelled_sample

SCHEMA = "doc_id long, held_out boolean, score double"


def blocks(text: bytes, size: int) -> list[bytes]:
    """The whole text in even blocks of at most ``size`` bytes."""
    n = -(-len(text) // size)
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


class Compressors:
    """Compressed sizes of blocks under each dictionary; contexts are made once per process."""

    def __init__(self, good: bytes, bad: bytes, block: int, level: int):
        self.good, self.bad, self.block, self.level, self._open = good, bad, block, level, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": None}

    def difference(self, text: bytes) -> float:
        """The normalised size difference; above 0 if the good dictionary fits better."""
        if not text:
            return 0.0
        if self._open is None:
            self._open = []
            for raw in (self.good, self.bad):
                kind = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
                kind.precompute_compress(level=self.level)
                self._open.append(zstandard.ZstdCompressor(dict_data=kind, write_checksum=False, write_content_size=False, write_dict_id=False))
        good = bad = 0
        for x in blocks(text, self.block):
            good, bad = good + len(self._open[0].compress(x)), bad + len(self._open[1].compress(x))
        return (bad - good) / (bad + good)


class Model:
    def __init__(self, compressors: Compressors | None, curve: np.ndarray, calibrated: Isotonic | None, share: float):
        self.compressors, self.curve, self.calibrated, self.share = compressors, curve, calibrated, share

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.compressors is None:
            return np.full(len(texts), self.share)
        x = np.array([self.compressors.difference(t) for t in texts])
        return np.clip(0.999 * self.calibrated(x) + 0.001 * sigmoid(x * self.curve[0] + self.curve[1]), 0, 1)


def train_dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    samples = [x for t in texts for x in blocks(t, block)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples: their text itself
        return b"".join(samples)[-size:] or b" " * 8


def train(rows: list[tuple[str, int]], dictionary: int = 64 << 10, block: int = 1024, level: int = 3) -> Model:
    """``rows``: (text, label)."""
    y = np.array([label for _, label in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(None, np.zeros(2), None, float(y.mean()) if len(y) else 0.5)
    texts = [t.encode() for t, _ in rows]
    first = np.arange(len(rows)) % 3 == 0
    by = [[t for t, label, k in zip(texts, y, first, strict=True) if label == v and k] for v in (1, 0)]
    compressors = Compressors(*(train_dictionary(x, dictionary, block) for x in by), block, level)
    x = np.array([compressors.difference(t) for t in texts])[~first]
    curve = logistic(x[:, None], y[~first], ridge=1e-3)
    curve[0] = max(curve[0], 0.0)
    return Model(compressors, curve, Isotonic().fit(x, y[~first]), float(y.mean()))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, at in K.pieces(batch.column("text")):
                raw = data.tobytes()
                out[lo:hi] = model.score([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out)], ["doc_id", "held_out", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2400, most_bytes: int = 1 << 15, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, score, predicted."""
    model = train(labelled_sample(docs, labels, "quality", 5, 0, per_class, most_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), "text").mapInArrow(_scorer(shared), SCHEMA)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
