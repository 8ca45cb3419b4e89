"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, node long, hits binary, items string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source)."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    texts: list[str | None] = [None, "", "   \n\t", "one", "one two", "ONE  two\x0b", "Straße ﬁn é", "x" * 3000, " ".join(words(rng, 9000, 5000))]
    for _ in range(n):
        own = words(rng, rng.choice([1, 2, 3, 8, 30, 60, 120, 250]))
        kind = rng.randrange(6)
        if kind == 0 and len(texts) > 12 and texts[-1]:
            own = texts[-1].split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        elif kind == 1:
            at = rng.randrange(len(own) + 1)
            own = own[:at] + passage[rng.randrange(10) :] + own[at:]
        elif kind == 2:
            own = ["again"] * len(own)
        texts.append(rng.choice([" ", "  ", "\n"]).join(own))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    rows = [(i, t, ("en", "de", None)[i % 3], ("hot", "hot", "s1", None)[i % 4]) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def make(spark):
    def make(rows, extra: bool = True):
        df = spark.createDataFrame([(*r, 7, 8, 9, 10, b"z", "q") for r in rows], AWKWARD)
        return df.repartition(3) if extra else df

    return make


@pytest.fixture(scope="session")
def docs(make):
    return make(corpus())
