"""Temperature mixing of sources to target weights, in DataFrame operations only.

Weights are token shares raised to an exponent and normalised. The exponent is
the least one at which the entropy of the weights is down to ``entropy`` times
its maximum and, as far as an exponent of at most 1 allows, no source is repeated more
than ``repeats`` times within the budget. Both conditions are monotone, so a bracket is narrowed in
rounds; each evaluates a row of exponents over the table of sources, and only
that row comes to the driver.

A source gets weight * budget tokens, rounded: whole epochs, then a part of one. Each
epoch reads the source's blocks in a new order, and each block's documents in a
new order; the last epoch stops at the last document that fits. Running totals
go over 256 lanes of the block order first, then over the blocks of a lane, and then
inside the block, so no source is ever in one task.

Null or empty texts have no tokens; such documents come along with their block.
A null source counts as ''. Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.llm.tables import materialize

TOKEN = r"[^\x20\x09-\x0D]+"
#: Exponents tried in a round; 257**5 steps are finer than a double's share of a token.
POINTS, ROUNDS = 257, 5
#: Tables of at most so many sources are broadcast.
FEW_SOURCES = 20_000


def _narrow(shares: DataFrame, low: float, high: float, holds: Column) -> float:
    """Least exponent in [low, high] at which ``holds`` (of h, r), which stays true from there on; high if none."""
    for _ in range(ROUNDS):
        step = (high - low) / (POINTS - 1)
        tried = shares.select("p", "r", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("i")).withColumn("e", low + F.col("i") * F.lit(step))
        power = F.pow("p", F.col("e"))
        sums = tried.groupBy("i").agg(F.sum(power).alias("z"), F.sum(power * F.col("e") * F.log("p")).alias("s"), F.max(power / F.col("p") * F.col("r")).alias("m"))
        first = sums.select("i", (F.log("z") - F.col("s") / F.col("z")).alias("h"), (F.col("m") / F.col("z")).alias("r")).where(holds).agg(F.min("i")).first()[0]
        if first is None:
            return high
        if first == 0:
            return low
        low, high = low + (first - 1) * step, low + first * step
    return high


def source_weights(tokens: DataFrame, budget: int | None, entropy: float, repeats: float) -> tuple[DataFrame, int, int]:
    """(source, n_docs, n_tokens, weight, quota) of each source with tokens, the budget, and the number of sources."""
    stats = materialize(tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0"))
    k, total = stats.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    budget = total if budget is None else budget
    if not k:
        return stats.withColumns({"weight": F.lit(0.0), "quota": F.lit(0).cast("long")}), budget, 0
    shares = stats.select((F.col("n_tokens") / F.lit(total)).alias("p"), F.lit(budget / total).alias("r"))
    even = _narrow(shares, 0.0, 8.0, F.col("h") <= F.lit(entropy) * F.log(F.lit(float(k))) + 1e-12)
    rare = _narrow(shares, 0.0, 1.0, F.col("r") <= repeats)
    power = F.pow(F.col("n_tokens") / F.lit(total), F.lit(max(even, rare)))
    norm = stats.agg(F.sum(power)).first()[0]
    weighted = stats.withColumn("weight", power / F.lit(norm))
    return weighted.withColumn("quota", F.round(F.col("weight") * F.lit(budget)).cast("long")), budget, k


def _key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def mix_sources(docs: DataFrame, budget: int | None = None, entropy: float = 0.95, repeats: float = 4.0, block_docs: int = 512, seed: str = "mix") -> DataFrame:
    """A row for each document read: source, weight, epoch, block_rank, rank, doc_id, n_tokens."""
    tokens = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"))
    tokens = materialize(tokens)
    sources, _, k = source_weights(tokens, budget, entropy, repeats)
    sources = materialize(
        sources.select(
            "source", "weight", F.ceil(F.col("n_docs") / block_docs).alias("blocks"), F.floor(F.col("quota") / F.col("n_tokens")).alias("full"), (F.col("quota") % F.col("n_tokens")).alias("part")
        )
    )
    few = (lambda x: F.broadcast(x)) if k <= FEW_SOURCES else (lambda x: x)
    # a document without id has a place of its own by its size
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("n_tokens").cast("string")))
    number = F.conv(F.substring(_key(seed, F.col("source"), identity), 1, 8), 16, 10).cast("long")
    placed = tokens.join(few(sources.drop("weight")), "source").withColumn("block", number % F.col("blocks")).withColumn("_id", identity)

    blocks = materialize(placed.groupBy("source", "block", "full", "part").agg(F.sum("n_tokens").alias("tokens")))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))
    blocks = blocks.withColumn("epoch", epochs).withColumn("_k", _key(seed, F.col("epoch"), F.col("source"), F.col("block"))).withColumn("lane", F.substring("_k", 1, 2))
    lanes = blocks.groupBy("source", "epoch", "lane").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("source", "epoch").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("source", "epoch", "lane", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_ahead") for c in ("n", "t")))
    order = Window.partitionBy("source", "epoch", "lane").orderBy("_k", "block")
    so_far = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.join(lanes, ["source", "epoch", "lane"])
    blocks = blocks.withColumn("block_rank", (F.row_number().over(order) + F.col("n_ahead")).cast("int")).withColumn("before", F.col("t_ahead") + so_far - F.col("tokens"))
    read = blocks.where("epoch < full or before < part").select("source", "block", "epoch", "block_rank", "before")

    rows = placed.join(read, ["source", "block"])
    inside = Window.partitionBy("source", "epoch", "block").orderBy(_key(seed, F.col("epoch"), F.col("source"), F.col("_id")), "_id", "n_tokens")
    rows = rows.withColumn("rank", F.row_number().over(inside)).withColumn("until", F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.where("epoch < full or until <= part")
    return rows.join(few(sources.select("source", "weight")), "source").select("source", F.round("weight", 9).alias("weight"), "epoch", "block_rank", "rank", "doc_id", "n_tokens")
