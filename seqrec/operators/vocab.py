"""Vocabulary, indexed sequences, training pairs and epoch sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.functions import arrays as A
from seqrec.operators.sequences import in_window, with_row_index
from seqrec.plans.lineage import small_side


def build_vocabulary(seq: DataFrame, column: str = "book_ids") -> DataFrame:
    """(book_id, book_index): 0-based in lexicographic order, indexed by range partitions rather than in one task."""
    tokens = seq.select(F.explode(column).alias("book_id")).where("book_id IS NOT NULL").distinct()
    return with_row_index(tokens, ["book_id"]).select("book_id", F.col("row_index").cast("int").alias("book_index"))


def index_sequences(seq: DataFrame, vocab: DataFrame) -> DataFrame:
    """(user_id, book_indices) in sequence order; tokens out of the vocabulary are dropped."""
    tokens = seq.select("user_id", F.posexplode("book_ids").alias("pos", "book_id"))
    return tokens.join(small_side(vocab), "book_id").groupBy("user_id").agg(A.ordered_list(F.col("book_index"), F.col("pos")).alias("book_indices"))


def training_pairs(indexed: DataFrame, window: int = 5, column: str = "book_indices") -> DataFrame:
    """(target_book_index, context_book_index) of all windows; narrow."""
    return indexed.select(F.explode(A.window_pairs(F.col(column), window)).alias("p")).select(F.col("p.target").alias("target_book_index"), F.col("p.context").alias("context_book_index"))


def training_pairs_selfjoin(indexed: DataFrame, window: int = 5, column: str = "book_indices") -> DataFrame:
    """The same pairs through a band self-join on user and position."""
    a = indexed.select("user_id", F.posexplode(column).alias("p1", "target_book_index"))
    b = indexed.select("user_id", F.posexplode(column).alias("p2", "context_book_index"))
    return a.join(b, "user_id").where(in_window(F.col("p1"), F.col("p2"), window)).select("target_book_index", "context_book_index")


def total_pairs(indexed: DataFrame, window: int = 5, column: str = "book_indices") -> DataFrame:
    """One row: number of pairs by the closed form; no pair is made."""
    return indexed.agg(F.coalesce(F.sum(A.pair_count(F.size(column), window)), F.lit(0)).alias("total_pairs"))


def epoch_fractions(total: int, sequences: int, max_pairs: int | None) -> tuple[float, float] | None:
    """(share of sequences, share of their pairs) for about ``max_pairs`` pairs, half as many again being drawn at first."""
    if max_pairs is None or total <= 0 or sequences <= 0:
        return None
    of_sequences = min(1.0, max(1.5 * max_pairs / total, 1.0 / sequences))
    return of_sequences, min(1.0, max_pairs / (total * of_sequences))


def epoch_pairs(indexed: DataFrame, window: int, fractions: tuple[float, float] | None, epoch_seed: int, max_pairs: int | None = None) -> DataFrame:
    """One epoch's pairs: seeded samples of sequences, then of pairs, then the limit that the caller asks for."""
    if fractions is None:
        return training_pairs(indexed, window)
    pairs = training_pairs(indexed.sample(False, fractions[0], epoch_seed), window).sample(False, fractions[1], epoch_seed + 17)
    if max_pairs is None:
        return pairs
    return pairs.orderBy(F.xxhash64(F.lit(epoch_seed), *pairs.columns), *pairs.columns).limit(max_pairs)  # by hash: a limit alone would take the first partitions
