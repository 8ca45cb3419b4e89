"""Reading tables, cutting lineage in the shared folder, and bounded training samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one serves a local master (tests); on a cluster it is an error, as executors don't share local folders."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandflow-")
        context.setCheckpointDir(where)
    return where


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that the table doesn't have, whatever the case of its names."""
    known = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


#: Tables that this process has written into the shared folder.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has written; call it when results that read them are stored. Returns their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: a lost executor costs no recomputation.

    Results are lazy and may read it later, so it stays until ``release``.
    """
    path = f"{shared_dir(df.sparkSession)}/strandflow-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, side: DataFrame, key: str, owner: str, sizes: DataFrame, most: int = 4096) -> DataFrame:
    """``rows`` joined to ``side`` (one row a key) by ``key``; a key of more than ``most`` rows is dealt to several tasks by ``owner``. ``sizes``: (key, n)."""
    wide = sizes.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).alias("_lanes"))
    lanes = F.coalesce("_lanes", F.lit(1))
    rows = rows.join(wide, key, "left").withColumn("_lane", F.pmod(F.xxhash64(owner), lanes)).drop("_lanes")
    side = side.join(wide, key, "left").withColumn("_lane", F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1))).drop("_lanes")
    return rows.join(side, [key, "_lane"]).drop("_lane")


def held_out(mod: int, rest: int) -> Column:
    """crc32 of doc_id as text leaves ``rest`` modulo ``mod``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, per_class: int, most_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` different training texts of each label, chosen by a hash of doc_id.

    The bound makes this a driver-side list of at most 2 * per_class * most_bytes
    bytes, however often an id or a text is repeated. Held-out rows, rows without
    id or text, and labels other than 0 and 1 take no part; texts over
    ``most_bytes`` bytes are left to scoring. An id with both labels counts as 1;
    a text under several ids has the label of the least.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"), held_out(mod, rest).alias("_h"))
    known = known.where(~F.col("_h") & F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_y").alias("_y"))
    parts = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    texts = (
        docs.select("doc_id", "text")
        .where(F.octet_length("text") <= most_bytes)
        .join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
        .groupBy(F.sha2("text", 256).alias("_k"))
        .agg(F.min(F.struct("doc_id", "_y", "text")).alias("_r"))
        .select("_k", "_r.*")
    )
    rows = [r for y in (0, 1) for r in texts.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "_k").limit(per_class).collect()]
    return [(r["text"], r["_y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["_k"]))]
