"""Jaccard join and components against brute force."""

from __future__ import annotations

import random
import re
import subprocess
import sys

import numpy as np
import pytest

from strandflow.llm import jaccard_join
from strandflow.llm.components import components
from strandflow.llm.jaccard_join import Rule, classes, keep_one
from tests.llm.conftest import corpus, words


def brute(rows, rule: Rule):
    sets, root = {}, {}
    for i, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[p : p + rule.words]) for p in range(max(1, len(w) - rule.words + 1))} if w else set()
        root[i] = i

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if rule.den * both >= rule.num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed: int, n: int, length: int, most: int):
    """Copies of one text with up to ``most`` words changed, dropped or added; a few are edits of edits."""
    rng = random.Random(seed)
    base = words(rng, length, 5000)
    out, texts = [], [base]
    for i in range(n):
        own = list(rng.choice(texts[-3:] if rng.random() < 0.4 else [base]))
        for _ in range(rng.randrange(most)):
            at = rng.randrange(len(own))
            kind = rng.randrange(3)
            if kind == 0:
                own[at] = f"n{rng.randrange(10**6)}"
            elif kind == 1:
                del own[at]
            else:
                own.insert(at, f"n{rng.randrange(10**6)}")
        texts.append(own)
        out.append((1000 + i * 7 % n, " ".join(own), "en", "hot"))
    return out


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (-7, 9)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {x: top(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("rule", "seed"), [(Rule(3, 90, 100), 1), (Rule(5, 80, 100), 2), (Rule(1, 1, 2), 3)])
def test_classes(make, rule, seed):
    rows = corpus(seed) + near_copies(seed, 90, 120, 9) + [(5000 + i, t, l, s) for i, t, l, s in near_copies(seed + 10, 60, 40, 5)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes(make(rows), rule).collect()}
    want = brute(rows, rule)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_many_open_rows(make, monkeypatch):
    """Blocks of rows in step 3, forced small."""
    from strandflow.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "PART_ROWS", 11)
    rows = near_copies(9, 120, 100, 14)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes(make(rows), Rule(3, 80, 100)).collect()}
    assert got == brute(rows, Rule(3, 80, 100))


def test_odd_rows(make):
    text = "a b c d e f g h"
    rows = [(None, text, None, None), (4, text, None, None), (4, text, None, None), (9, text, None, None), (7, None, None, None), (8, "", None, None)]
    df = make(rows)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in classes(df).collect()), key=str)
    assert got == [(4, 6, 4), (4, 6, 4), (7, 0, 7), (8, 0, 8), (9, 6, 4), (None, 6, None)]
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [4, 7, 8, None]
    assert classes(df.limit(0)).count() == 0


def test_kept_rows_are_those_of_classes(spark):
    """Ids with several texts, repeated rows, and columns named like our own."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (6, b, 4), (6, b, 5), (6, c, 6), (6, c, 7), (7, None, 8), (7, "", 9), (None, a, 10)]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id int, text string, _key long, _gone string, _Node int")
    kept = keep_one(df.repartition(3))
    assert kept.columns == df.columns and kept.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    got = sorted(r["_key"] for r in kept.collect())
    assert got in ([1, 3, 6, 8, 9, 10], [1, 3, 7, 8, 9, 10])
    assert keep_one(df.limit(0)).count() == 0


def test_buckets_follow_the_keys(make, monkeypatch):
    """Many small buckets, merged in small steps, against brute force."""
    from strandflow.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BUCKET_KEYS", 150)
    monkeypatch.setattr(jaccard_join, "BUCKETS", 1)
    rows = corpus(4) + near_copies(4, 60, 80, 6)
    assert jaccard_join.buckets_for(Rule(), 100, 10_000) > 10 * jaccard_join.buckets_for(Rule(), 10, 500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes(make(rows), Rule(3, 90, 100)).collect()}
    assert got == brute(rows, Rule(3, 90, 100))


def test_a_bucket_of_one_hot_key_stays_small():
    """Rows that all share a key take one place, however many there are."""
    import numpy as np
    import pyarrow as pa

    from strandflow.llm import jaccard_join as j

    held = []
    ends = j._ends

    def watched(keys, least, most):
        held.append(len(keys))
        return ends(keys, least, most)

    j._ends = watched
    try:
        parts = [j.pack(np.arange(i * 100, i * 100 + 100), np.ones(100, np.int64), np.full(100, 77, np.uint64)) for i in range(300)]
        batches = (pa.RecordBatch.from_arrays([pa.array([5], pa.int32()), pa.array([p], pa.binary())], ["bucket", "part"]) for p in parts)
        (out,) = j._shared_keys(500)(batches)
    finally:
        j._ends = ends
    assert out.num_rows == 1 and out.column("pivot")[0].as_py() == 0 and max(held) < 700


MEMORY = """
import ctypes, numpy as np, pyarrow as pa
from strandflow.llm import jaccard_join as J

def mb(what):
    return next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith(what)) // 1024

rng = np.random.default_rng(6)
vocabulary = np.array([f"word{i}" for i in range(5000)])
texts = pa.array([" ".join(w) for w in vocabulary[rng.integers(0, 5000, (12000, 300))]])
ctypes.CDLL(None).malloc_trim(0)
base, rows = mb("VmRSS"), 0
open("/proc/self/clear_refs", "w").write("5")
for out in J._dealt(J.Rule(5, 80, 100), 64)(iter([pa.record_batch([texts], ["text"])])):
    rows += out.num_rows
del out
print(rows, mb("VmHWM") - base, mb("VmRSS") - base)
"""


def test_dealt_blocks_stay_small_and_leave_nothing():
    run = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True)
    rows, peak, after = map(int, run.stdout.split())
    assert rows == 2 * 64  # two blocks in all buckets
    assert peak < 200 and after < 60


def test_entries_of_a_block_by_key():
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 1 << 64, 40, np.uint64, endpoint=False)[rng.integers(0, 40, 300)]
    row, node = rng.integers(0, 90, 300).astype(np.int32), rng.permutation(90) - 45
    keys, row = (np.array(x) for x in zip(*dict.fromkeys(zip(keys.tolist(), row.tolist(), strict=True)), strict=True))
    keys, want = keys.astype(np.uint64), set()
    for k in set(keys.tolist()):
        own = sorted((int(node[r]), int(r)) for r in row[keys == np.uint64(k)])
        want |= {(k, r) for _, r in (own[0], own[-1])}
    got, of = jaccard_join._ends_only(keys, row, node)
    assert sorted(zip(got.tolist(), of.tolist(), strict=True)) == sorted(want) and (np.diff(got.astype(object)) >= 0).all()
    for buckets in (1, 7, 64):
        edge = jaccard_join.bucket_edges(got, buckets)
        assert np.repeat(np.arange(buckets), np.diff(edge)).tolist() == jaccard_join.bucket_of(got, buckets).tolist()
    assert jaccard_join.bucket_edges(np.array([0, 1 << 32, (1 << 64) - 1], np.uint64), 3).tolist() == [0, 2, 2, 3]
