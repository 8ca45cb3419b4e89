"""The pipeline's stages on the small tables: columns, decisions, and brute force."""

from __future__ import annotations

import re

import corpus_pipeline
from strandflow.llm import secret_scan
from strandflow.llm.jaccard_join import Rule
from strandflow.llm.tables import materialize, table
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import realise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF))
        out[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == columns
    rows = lambda df: [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]

    kept = {r[0] for r in rows(out["toxicity"][1])}
    assert len(kept) > 0.8 * out["toxicity"][0].count()

    before, after = map(rows, out["near_duplicates"])
    classes = brute(before, Rule(5, 80, 100))
    assert {r[0] for r in after} == {i for i, (_, c) in classes.items() if c == i}

    before, after = map(rows, out["decontamination"])
    tok = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
    items = [tok(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    wanted = {tuple(w[i : i + 8]) for w in items for i in range(len(w) - 7)}
    assert {r[0] for r in after} == {r[0] for r in before if not any(tuple(w[i : i + 8]) in wanted for w in [tok(r[1])] for i in range(len(w) - 7))}

    before, after = out["secrets"]
    old, new = {r[0]: r[1] for r in rows(before)}, {r[0]: r[1] for r in rows(after)}
    assert {i: secret_scan.without_spans(t, "[SECRET]") for i, t in old.items()} == new
    assert not any(secret_scan.find_spans(t) for t in new.values())
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    got = sorted((r["source"], r["epoch"], r["block_rank"], r["rank"], r["doc_id"], r["n_tokens"]) for r in out["mixing"][1].collect())
    assert got == sorted((s, *rest) for s, _, *rest in realise(rows(out["mixing"][0]), 0.95, 4.0, 512))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
