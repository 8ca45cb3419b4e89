"""Structured Streaming versions, over several micro-batches."""

from __future__ import annotations

import time
import uuid

import pytest
from pyspark.sql import functions as F

from strandflow import sources, streaming
from tests.test_streams import GOLDEN, GOLDEN_PANES, WORDS


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    streaming.use_rocksdb(spark)


def files(spark, path, rows, schema, parts=3):
    """Rows as several files in order, for as many micro-batches."""
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    return sources.file_stream(spark, str(path), schema)


def run(df, checkpoint=None):
    name = "q" + uuid.uuid4().hex
    writer = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_running_count(spark, tmp_path):
    df = files(spark, tmp_path / "in", list(enumerate(WORDS)), "seq long, value string")
    got = run(streaming.running_count(df, "value"))
    seen: dict = {}
    want = []
    for i, w in enumerate(WORDS):
        seen[w] = seen.get(w, 0) + 1
        want.append((i, w, seen[w]))
    assert sorted((r["seq"], r["value"], r["n"]) for r in got) == want


def test_exact_windows(spark, tmp_path):
    rows = [(i, k, t, t - 5) for i, (t, k) in enumerate(GOLDEN)]
    df = files(spark, tmp_path / "in", rows, "seq long, value string, _ts long, _wm long")
    got = run(streaming.fire(streaming.running_watermark(df), "value", 5, 2))
    for key, want in GOLDEN_PANES.items():
        assert sorted((r["start"], r["n"]) for r in got if r["value"] == key) == sorted(want)
    assert len(got) == 28


def test_merged_watermark(spark, tmp_path):
    rows = [(0, 0, 0, 0), (1, 1, 10, 5), (2, 2, 8, 3), (3, 0, 11, 10), (4, 1, 5, 0), (5, 2, 9, 6)]
    df = files(spark, tmp_path / "in", rows, "seq long, source int, _ts long, _wm long", 2)
    got = run(streaming.running_watermark(df, source="source"))
    assert [r["_wm"] for r in sorted(got, key=lambda r: r["seq"])] == [0, 0, 0, 3, 3, 5]


def test_align(spark, tmp_path):
    left = files(spark, tmp_path / "a", [(i, w.upper()) for i, w in enumerate(WORDS[:4])], "seq long, value string", 2)
    right = files(spark, tmp_path / "b", [(i, str(len(w))) for i, w in enumerate(WORDS[:6])], "seq long, value string", 3)
    got = run(streaming.align(left, right))
    assert sorted((r["left"], r["right"]) for r in got) == sorted((w.upper(), str(len(w))) for w in WORDS[:4])


def test_user_step(spark, tmp_path):
    """A state that only Python knows, kept over micro-batches."""
    rows = [(i, "ab"[i % 2], i * 10) for i in range(12)]
    df = files(spark, tmp_path / "in", rows, "seq long, key string, _value long")

    def step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
        state = {"last": row["_value"], "seen": state["seen"] + [row["seq"]]}
        return state, [(row["key"], row["seq"], len(state["seen"]), sum(state["seen"]))]

    got = run(streaming.fold(df, "key", {"last": None, "seen": []}, step, "_key string, seq long, n int, total long"))
    want, seen = [], {"a": [], "b": []}
    for i, k, _ in rows:
        seen[k].append(i)
        want.append((k, i, len(seen[k]), sum(seen[k])))
    assert sorted((r["_key"], r["seq"], r["n"], r["total"]) for r in got) == sorted(want)


def test_own_fold_in_windows(spark, tmp_path):
    rows = [(i, k, t, t - 5) for i, (t, k) in enumerate(GOLDEN)]
    df = files(spark, tmp_path / "in", rows, "seq long, value string, _ts long, _wm long")
    longest = dict(start=[], add=lambda held, v: [*held, v], finish=lambda held: (",".join(held), len(held)), schema="words string, size int")
    got = run(streaming.fire(streaming.running_watermark(df), "value", 5, 2, value=F.col("value"), **longest))
    for key, want in GOLDEN_PANES.items():
        assert sorted((r["start"], r["size"]) for r in got if r["value"] == key) == sorted(want)
    assert all(r["words"] == ",".join([r["value"]] * r["size"]) for r in got)
