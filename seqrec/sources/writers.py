"""Sinks: parquet tables, JSON artifacts and models, all through Hadoop file systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table; overwrite mode replaces recursive delete and mkdir."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_artifact(spark: SparkSession, path: str, content: dict | DataFrame) -> None:
    """Write a small JSON document (a dict, or a one-row frame) to any file system that Spark reaches."""
    text = json.dumps(content, indent=2, default=str) if isinstance(content, dict) else json.dumps(json.loads(content.toJSON().first()), indent=2)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_json_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def save_model(embeddings: DataFrame, vocab: DataFrame, folder: str) -> None:
    folder = folder.rstrip("/")
    write_parquet(embeddings, f"{folder}/embeddings")
    write_parquet(vocab, f"{folder}/vocab")
