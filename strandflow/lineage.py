"""Cutting lineage in the shared folder, so that iterations survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints into spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master (tests); on a cluster it is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="strandflow-"))
    return df.checkpoint()
