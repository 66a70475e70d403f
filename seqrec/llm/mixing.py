"""Mixing sources to target weights.

Tokens are aggregated per source, each source gets a target by water-filling, and a document is
emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy, rate = target / source size.

Defined cases: a null text has size 0; null is a source of its own and comes last; a source of size 0
has target 0; repeated rows draw alike (the draw is seeded by the id); an empty table gives an empty
mix; other columns of the input are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.llm.words import word_count
from seqrec.plans.lineage import BROADCAST_ROWS, materialize

#: Weights dealt to the sources in code-point order, over and over.
WEIGHTS = (5, 2, 1)
#: The mix as a share of all sizes, and the most that a source is repeated.
SHARE, MOST = 1.5, 2.0
SEED = "mix-7"
SALT = 32


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> plus ``weight``, ``target``.

    Every target is min(most * size, level * weight), with the one level that makes the targets add up to
    share * total. Sources in order of most * size / weight fill up first, so the level follows from running
    sums. The table has a row per source; its windows see sources, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    picks = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(picks, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_fills", F.col("_cap") / F.col("weight"))
    upto = Window.orderBy("_fills").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    runs = ranked.select(
        "*",
        F.sum("_cap").over(upto).alias("_capped"),
        (F.sum("weight").over(every) - F.sum("weight").over(upto)).alias("_left"),
        (share * F.sum("source_size").over(every)).alias("_total"),
    ).withColumn("_full", F.col("_capped") + F.col("_fills") * F.col("_left") <= F.col("_total"))
    level = runs.select("*", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every).alias("_done"), F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every).alias("_open"))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_total") - F.col("_done")) * F.col("weight") / F.col("_open"))
    return level.select("source", "source_size", "weight", F.least(target, F.col("_cap")).alias("target"))


def copies(rate, key, seed: str = SEED):
    """floor(rate) plus one with the probability of the fraction; the draw is a hash of seed and key."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def attach_targets(docs: DataFrame, targets: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join (…, source, size) with the per-source table: broadcast behind a count, else salted on both sides."""
    named = targets.select(F.col("source").alias("_s"), "source_size", "target")
    if named.count() <= broadcast_rows:
        return docs.join(F.broadcast(named), docs["source"].eqNullSafe(named["_s"]), "inner").drop("_s")
    spread = named.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    return salted.join(spread, salted["source"].eqNullSafe(spread["_s"]) & (F.col("_salt") == F.col("_salt2")), "inner").drop("_s", "_salt", "_salt2")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """One row per document: id, source, size, source_size, target, n_copies, taken (long)."""
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    joined = attach_targets(sized, targets, broadcast_rows)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = joined.withColumn("n_copies", copies(rate, F.col("id")))
    return out.withColumn("taken", F.col("size") * F.col("n_copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The mix itself: every input row as often as it is taken, with all its columns.

    The rate is a property of the source, so the texts meet only the per-source table and are never shuffled.
    """
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    joined = attach_targets(whole, targets, broadcast_rows)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = copies(rate, F.col("id"))
    return joined.withColumn("_n", n).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("row.*")
