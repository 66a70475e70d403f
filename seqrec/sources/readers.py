"""Declared schemas and readers for interactions, item metadata, sequences and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERACTIONS = "user_id string, book_id string, is_read int, rating int, is_reviewed int"
BOOKS = "book_id string, title string, title_without_series string, average_rating string, ratings_count string, publication_year string, work_id string, series array<string>, authors array<struct<author_id: string>>"
AUTHORS = "author_id string, name string"
GENRES = "book_id string, genres map<string, int>"
WORKS = "work_id string, original_title string, original_publication_year string"
REVIEWS = "user_id string, book_id string, read_at string, date_added string"
JSON_KINDS = {"books": BOOKS, "authors": AUTHORS, "genres": GENRES, "works": WORKS, "reviews": REVIEWS}


def read_interactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Interaction CSV with a header; the schema is declared, so no inference pass reads the files."""
    return spark.read.schema(INTERACTIONS).csv(path, header=True)


def read_interactions_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Interactions as (user_id string, book_id string, rating double); rows with a null in any are dropped."""
    return dropna_cast(spark.read.parquet(path))


def dropna_cast(df: DataFrame) -> DataFrame:
    """Cast to (user_id string, book_id string, rating double) and drop rows with a null in any."""
    cast = df.select(F.col("user_id").cast("string").alias("user_id"), F.col("book_id").cast("string").alias("book_id"), F.col("rating").try_cast("double").alias("rating"))
    return cast.dropna(subset=["user_id", "book_id", "rating"])


def read_json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of one of the declared kinds; object-valued genres are read as a map directly."""
    return spark.read.schema(JSON_KINDS[kind]).json(path)


def load_user_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("user_id", "book_ids")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system that its scheme names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_metadata_lookup(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(book_id, title), or None without a path or a table there."""
    if not path or not exists(spark, path):
        return None
    return spark.read.parquet(path).select("book_id", "title")


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(embeddings, vocab, book embeddings) of a saved model."""
    from seqrec.operators.trainer import book_embeddings

    folder = folder.rstrip("/")
    embeddings, vocab = spark.read.parquet(f"{folder}/embeddings"), spark.read.parquet(f"{folder}/vocab")
    return embeddings, vocab, book_embeddings(embeddings, vocab)


def parse_id_list(text: str) -> list[str]:
    """Comma-separated ids, trimmed, empty ones dropped."""
    return [x for x in (p.strip() for p in text.split(",")) if x]


def parse_title_lines(text: str) -> list[str]:
    """Titles from a text, one a line, blank lines dropped."""
    return [x for x in (p.strip() for p in text.splitlines()) if x]


def map_known_ids(ids: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Ids joined to their mapping; unknown ones are ignored."""
    return ids.join(mapping, key, "inner")
