"""Run manifest and validation report as one-row frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.operators.metadata import missing_metadata
from seqrec.operators.sequences import surviving_ids


def length_stats(seq: DataFrame, column: str = "book_ids") -> DataFrame:
    n = F.size(column)
    return seq.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.percentile_approx(n, 0.5), F.lit(0)).cast("long").alias("median_length"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_length"),
    )


def manifest_counts(seq: DataFrame) -> DataFrame:
    return seq.agg(F.count(F.lit(1)).alias("user_count")).crossJoin(surviving_ids(seq).agg(F.count(F.lit(1)).alias("vocabulary_size")))


def coverage(seq: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: vocabulary, covered, missing, coverage % (0 for an empty vocabulary, 4 places)."""
    ids = surviving_ids(seq)
    sizes = ids.agg(F.count(F.lit(1)).alias("vocabulary_size")).crossJoin(missing_metadata(ids, metadata).agg(F.count(F.lit(1)).alias("missing")))
    out = sizes.withColumn("covered", F.col("vocabulary_size") - F.col("missing"))
    return out.withColumn("coverage_pct", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("covered"), F.col("vocabulary_size").cast("double")), F.lit(0.0)), 4))


def validation_report(seq: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: users, duplicates, lengths, short sequences, nested metadata coverage. All sides are one-row aggregates."""
    users = seq.agg(F.count(F.lit(1)).alias("user_count"), F.count_distinct("user_id").alias("distinct_users"), F.count(F.when(F.size("book_ids") < 2, 1)).alias("short_sequences"))
    out = users.withColumn("duplicate_users", F.col("user_count") - F.col("distinct_users")).crossJoin(length_stats(seq)).crossJoin(coverage(seq, metadata))
    nested = F.struct("vocabulary_size", "covered", "missing", "coverage_pct")
    return out.select("user_count", "distinct_users", "duplicate_users", "short_sequences", "tokens", F.round("avg_length", 4).alias("avg_length"), "median_length", "max_length", nested.alias("metadata_coverage"))


def manifest(seq: DataFrame, sources: dict[str, str], outputs: dict[str, str], trim_limit: int = 200, min_count: int = 10) -> dict:
    """The run manifest as a document: time, sources, outputs, parameters, counts."""
    from datetime import UTC, datetime

    n = manifest_counts(seq).first()
    return {"generated_at": datetime.now(UTC).isoformat(), "sources": sources, "outputs": outputs, "trim_limit": trim_limit, "min_count": min_count, "user_count": n["user_count"], "vocabulary_size": n["vocabulary_size"]}
