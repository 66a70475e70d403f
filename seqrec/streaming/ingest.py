"""Streaming ingest: interactions as they arrive, filtered like the batch path, kept as an append-only table.

Sequences are built from that table in batch: a user's order needs the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqrec.operators.sequences import positive_interactions

TIMED = "user_id string, book_id string, is_read int, rating int, ts timestamp"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder; the schema is declared."""
    return spark.readStream.schema(TIMED).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(stream: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append positive interactions to a parquet table, partitioned by day; exactly once per input file."""
    rows = positive_interactions(stream).withColumn("day", F.to_date("ts"))
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).partitionBy("day").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def item_counts(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Positive interactions per item and window, with a watermark for late rows."""
    kept = positive_interactions(stream).withWatermark("ts", late)
    return kept.groupBy(F.window("ts", size), "book_id").agg(F.count(F.lit(1)).alias("n"))
