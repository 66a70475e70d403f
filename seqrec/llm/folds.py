"""Fold rule and bounded, hash-drawn samples of labelled rows for the fitted operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.plans.lineage import small_side


def held_out(id_: Column) -> Column:
    """True for ids whose crc32 (of the id as text) leaves 0 modulo 5; a null id is never held out, nor learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(id_: Column) -> Column:
    return id_.isNotNull() & ~held_out(id_)


def draw(id_: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from a hash of the id."""
    return F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1 << 30)) / F.lit(float(1 << 30))


def per_group_sample(rows: DataFrame, id_col: str, group_col: str, most: int, seed: int) -> DataFrame:
    """Rows of each group drawn by id hash at a rate that gives about ``most`` of them (all, if there are fewer).

    The rates come from a count of all rows; they are one row per group.
    """
    rates = rows.groupBy(F.col(group_col).alias("_g")).agg((F.lit(float(most)) / F.count(F.lit(1))).alias("_rate"))
    return rows.join(small_side(rates), rows[group_col] == F.col("_g")).where(draw(F.col(id_col), seed) < F.col("_rate")).drop("_g", "_rate")
