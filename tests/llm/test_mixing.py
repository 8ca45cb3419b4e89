"""Temperature mixing against a plain realisation, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re

import pytest

from strandflow.llm.mixing import mix_sources
from tests.llm.conftest import corpus


def plan(rows, entropy, repeats, budget=None):
    tokens = [(i, s or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in rows]
    stats = {}
    for _, s, n in tokens:
        stats.setdefault(s, [0, 0])
        stats[s][0] += 1
        stats[s][1] += n
    stats = {s: v for s, v in stats.items() if v[1]}
    total = sum(n for _, n in stats.values())
    budget = budget or total

    def weights(e):
        z = {s: (n / total) ** e for s, (_, n) in stats.items()}
        return {s: x / sum(z.values()) for s, x in z.items()}

    def least(high, holds):
        lo, hi = 0.0, high
        if holds(weights(0.0)):
            return 0.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if holds(weights(mid)) else (mid, hi)
        return hi

    e = max(least(8.0, lambda w: -sum(x * math.log(x) for x in w.values()) <= entropy * math.log(len(w)) + 1e-12), least(1.0, lambda w: max(x * budget / stats[s][1] for s, x in w.items()) <= repeats))
    return tokens, stats, weights(e), budget


def key(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def realise(rows, entropy, repeats, block_docs, budget=None):
    tokens, stats, weights, budget = plan(rows, entropy, repeats, budget)
    out = []
    for s, (docs, own) in stats.items():
        blocks: dict = {}
        for i, t, n in tokens:
            if t == s:
                name = str(i) if i is not None else f"-{n}"
                blocks.setdefault(int(key("mix", s, name)[:8], 16) % -(-docs // block_docs), []).append((i, name, n))
        quota = round(weights[s] * budget)
        for epoch in range(quota // own + 1):
            read = 0
            for rank, b in enumerate(sorted(blocks, key=lambda b: (key("mix", epoch, s, b), b)), 1):
                before = read
                for place, (i, name, n) in enumerate(sorted(blocks[b], key=lambda d: (key("mix", epoch, s, d[1]), d[1], d[2])), 1):
                    read += n
                    if epoch < quota // own or before < quota % own and read <= quota % own:
                        out.append((s, round(weights[s], 6), epoch, rank, place, i, n))
    return out


@pytest.mark.parametrize(("entropy", "repeats", "budget"), [(0.9, 4.0, None), (1.0, 1.5, None), (0.3, 9.0, None), (0.99, 3.0, 30_000)])
def test_mixing(make, entropy, repeats, budget):
    rows = corpus(4, 120)
    got = mix_sources(make(rows), budget, entropy, repeats, block_docs=7).collect()
    got = sorted((r["source"], round(r["weight"], 6), r["epoch"], r["block_rank"], r["rank"], r["doc_id"], r["n_tokens"]) for r in got)
    assert got == sorted(realise(rows, entropy, repeats, 7, budget))
    _, stats, _, budget = plan(rows, entropy, repeats, budget)
    assert sum(r[-1] for r in got) <= budget + len(stats)


def test_mixing_odd(make):
    df = make([(1, None, None, None), (2, "", None, "a")])
    assert mix_sources(df).count() == 0
    assert mix_sources(df.limit(0)).count() == 0
    same = make([(1, "a b", None, "x"), (1, "a b", None, "x"), (None, "c", None, "x")])
    assert sorted(str(r["doc_id"]) for r in mix_sources(same).collect()) == ["1", "1", "None"]
