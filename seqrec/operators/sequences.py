"""From interactions to clean, ordered user sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrec.functions import arrays as A
from seqrec.plans.lineage import drop, materialize, small_side


def positive_interactions(df: DataFrame) -> DataFrame:
    """Rows read and rated above zero."""
    return df.where("is_read = 1 AND rating > 0")


def rating_threshold(df: DataFrame, least: float = 3.0) -> DataFrame:
    return df.where(F.col("rating") >= least)


def dedup_pairs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``, so reruns agree."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def user_sequences(df: DataFrame, order: list[str], user: str = "user_id", item: str = "book_id") -> DataFrame:
    """(user_id, book_ids) in the order of the key columns; one shuffle by user."""
    return df.groupBy(user).agg(A.ordered_list(F.col(item), *[F.col(c) for c in order]).alias("book_ids"))


def min_length(seq: DataFrame, least: int = 2, column: str = "book_ids") -> DataFrame:
    return seq.where(F.size(column) >= least)


def frequent_tokens(seq: DataFrame, least: int = 10, column: str = "book_ids") -> DataFrame:
    """Tokens that occur at least ``least`` times, with their counts."""
    return seq.select(F.explode(column).alias("book_id")).groupBy("book_id").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= least)


def keep_tokens(seq: DataFrame, valid: DataFrame) -> DataFrame:
    """Sequences without the tokens missing from ``valid``, order kept; users left without tokens go."""
    tokens = seq.select("user_id", F.posexplode("book_ids").alias("pos", "book_id"))
    kept = tokens.join(small_side(valid.select("book_id")), "book_id", "left_semi")
    return kept.groupBy("user_id").agg(A.ordered_list(F.col("book_id"), F.col("pos")).alias("book_ids"))


def clean_sequences(df: DataFrame, order: list[str], trim: int = 200, keep: str = "first", least_count: int = 10, least_length: int = 2, redo_dedup: bool = False) -> DataFrame:
    """Filter, order, drop consecutive repeats, trim, drop short, drop rare tokens, drop short.

    Rare tokens are counted once, after the first length filter. ``redo_dedup`` removes the consecutive
    repeats that dropping tokens can bring about; by default they stay.
    """
    seq = user_sequences(positive_interactions(df), order)
    seq = min_length(seq.select("user_id", A.trim(A.consecutive_dedup(F.col("book_ids")), trim, keep).alias("book_ids")), least_length)
    seq = materialize(seq, "sequences")  # counted and filtered: two readers
    out = keep_tokens(seq, frequent_tokens(seq, least_count))
    if redo_dedup:
        out = out.select("user_id", A.consecutive_dedup(F.col("book_ids")).alias("book_ids"))
    return min_length(out, least_length)


def surviving_ids(seq: DataFrame) -> DataFrame:
    return seq.select(F.explode("book_ids").alias("book_id")).distinct()


def min_history(df: DataFrame, least: int = 5, user: str = "user_id") -> DataFrame:
    """Rows of users with at least ``least`` rows; one shuffle by user."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(user))).where(F.col("_n") >= least).drop("_n")


def k_core(df: DataFrame, k: int = 5, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Largest set of rows where every user and every item has at least k; repeated until nothing changes (each round loses rows, so it ends)."""
    now = materialize(df, "core")
    before, n = -1, now.count()
    while n != before:
        users = now.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(user)
        step = now.join(users, user, "left_semi")
        items = step.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(item)
        fresh = materialize(step.join(items, item, "left_semi").select(*df.columns), "core")
        drop(df.sparkSession, now)
        now, before, n = fresh, n, fresh.count()
    return now


def leave_one_out(df: DataFrame, order: list[str], user: str = "user_id") -> DataFrame:
    """Adds ``split``: the last row of a user is test, the one before validation (users of 3 rows or more), the rest train."""
    w = Window.partitionBy(user)
    back = F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))
    n = F.count(F.lit(1)).over(w)
    split = F.when(n < 3, F.lit("train")).when(back == 1, F.lit("test")).when(back == 2, F.lit("valid")).otherwise(F.lit("train"))
    return df.withColumn("split", split)


def holdout_split(pos: DataFrame, share_inverse: int = 5, seed: int = 43) -> DataFrame:
    """Adds ``is_holdout``: of each user's rows in seeded order the first max(1, ceil(n / share_inverse))."""
    from seqrec.functions.text_time import seeded_order

    w = Window.partitionBy("user_id")
    rn = F.row_number().over(w.orderBy(seeded_order(seed, F.col("user_id"), F.col("book_id")), "book_id"))
    n = F.count(F.lit(1)).over(w)
    return pos.withColumn("_rn", rn).withColumn("_n", n).withColumn("is_holdout", F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.col("_n") / share_inverse))).drop("_rn", "_n")


def random_sentences(pos: DataFrame, seed: int = 42, least: int = 2) -> DataFrame:
    """Per-user sentences in seeded random order, of at least ``least`` items."""
    from seqrec.functions.text_time import seeded_order

    seq = pos.groupBy("user_id").agg(A.ordered_list(F.col("book_id"), seeded_order(seed, F.col("user_id"), F.col("book_id"))).alias("sentence"))
    return seq.where(F.size("sentence") >= least)


def item_sets(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("user_id").agg(F.array_sort(F.collect_set("book_id")).alias(name))


def in_window(p1: Column, p2: Column, w: int) -> Column:
    """Positions at most w apart and not the same."""
    return (F.abs(p1 - p2) <= w) & (p1 != p2)


def with_row_index(df: DataFrame, order: list[str]) -> DataFrame:
    """0-based global index in key order without a one-task window: range-sorted partitions, offsets from their counts."""
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "indexed")
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.join(F.broadcast(offsets), "_p").select(*df.columns, (F.col("_o") + local).alias("row_index"))
