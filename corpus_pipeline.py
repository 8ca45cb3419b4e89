"""Corpus pipeline: five stages from raw documents to a mixed training order.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of documents.
Stages are written to the shared folder as Parquet and read again in between.

toxicity          documents that score 0.5 or more go
near_duplicates   five-word shingles, similarity 0.8: the least doc_id of each class stays
decontamination   documents with a window of any benchmark item go
secrets           spans of secrets are replaced by a mark; documents stay
mixing            the reading order of the kept documents under target weights
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm.decontamination import drop_contaminated
from strandflow.llm.jaccard_join import Rule, keep_one
from strandflow.llm.mixing import mix_sources
from strandflow.llm.secret_scan import redact
from strandflow.llm.tables import materialize, table
from strandflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, Rule(words=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: SQL can't express the trained and the iterative stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
