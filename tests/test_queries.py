"""Every registered stream query against its SQL, and the driver's contract."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from strandflow import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


#: Compared by a digest of all rows.
LARGE = ("bench_wordcount", "generated_words")


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = pd.DataFrame({c: df[c].round(6) if df[c].dtype.kind == "f" else df[c].astype(str) for c in df})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    if name in LARGE:
        duck.register("got", queries.QUERIES[name](spark, SF).toArrow())
        digest = "select count(*), bit_xor(hash(seq, value)), min(seq), max(seq) from "
        assert duck.sql(digest + "got").fetchall() == duck.sql(f"{digest} ({queries.ORACLES[name]})").fetchall()
        return
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(canonical(got), canonical(want), check_dtype=False)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
