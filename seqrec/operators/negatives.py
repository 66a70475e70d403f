"""Negative sampling: distribution, alias table, draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def token_counts(indexed: DataFrame, column: str = "book_indices") -> DataFrame:
    return indexed.select(F.explode(column).alias("book_index")).groupBy("book_index").agg(F.count(F.lit(1)).alias("cnt"))


def zero_filled_counts(spark: SparkSession, counts: DataFrame, size: int) -> DataFrame:
    """A row for each index in [0, size), 0 where it never occurs."""
    every = spark.range(size).select(F.col("id").alias("book_index"))
    return every.join(counts, "book_index", "left").select("book_index", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def negative_distribution(spark: SparkSession, indexed: DataFrame, size: int, power: float = 0.75) -> DataFrame:
    """(book_index, probability) with probability = count^power / sum; the total is a one-row side."""
    weights = zero_filled_counts(spark, token_counts(indexed), size).select("book_index", F.pow("cnt", F.lit(power)).alias("w"))
    total = weights.agg(F.sum("w").alias("t"))
    return weights.crossJoin(F.broadcast(total)).select("book_index", F.coalesce(F.try_divide("w", "t"), F.lit(0.0)).alias("probability"))


def alias_table(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables (prob, alias) to draw from p in constant time: cell i keeps i with prob[i], else gives alias[i].

    Cells under the mean are topped up by the current donor; what rounding leaves over keeps itself.
    """
    share = np.asarray(p, float) * len(p)
    prob, alias = np.ones(len(p)), np.arange(len(p))
    poor, rich = [i for i in range(len(p)) if share[i] < 1], [i for i in range(len(p)) if share[i] >= 1]
    while poor and rich:
        low, donor = poor.pop(), rich[-1]
        prob[low], alias[low] = share[low], donor
        share[donor] -= 1 - share[low]
        if share[donor] < 1:
            poor.append(rich.pop())
    return prob, alias


def sample_negatives(pairs: DataFrame, distribution: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """Adds ``negatives`` array<int>: k draws with replacement a pair; a draw may hit the target or context.

    The vocabulary's distribution goes to every executor; its size is the vocabulary's.
    """
    table = distribution.orderBy("book_index").toPandas()
    shared = pairs.sparkSession.sparkContext.broadcast((table["book_index"].to_numpy(), *alias_table(table["probability"].to_numpy())))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, prob, alias = shared.value
        for pdf in frames:
            if not len(pdf):
                continue
            rng = np.random.Generator(np.random.PCG64([seed, int(pdf["_key"].iloc[0])]))
            cell, coin = rng.integers(0, len(index), (len(pdf), k)), rng.random((len(pdf), k))
            picked = index[np.where(coin < prob[cell], cell, alias[cell])]
            yield pdf.drop(columns="_key").assign(negatives=list(picked.astype(np.int32)))

    fields = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)
    keyed = pairs.withColumn("_key", F.xxhash64(*pairs.columns).bitwiseAND(F.lit((1 << 62) - 1)))
    return keyed.mapInPandas(draw, f"{fields}, negatives array<int>")
