"""Views of the supplied star schema in the roles of interactions, books and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of a user's interactions; the first two line keys are not unique together.
ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, book_id, is_read, rating and the order key, from order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("ts"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("book_id"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("is_read"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("rating"),
        *ORDER,
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, book_id, rating double: the timestamp-free variant."""
    return interactions(spark, sf_dir).select("user_id", "book_id", F.col("rating").cast("double").alias("rating"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as books: title, rating, nested authors (the part's suppliers) are linked by ``author_links``."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("book_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("average_rating"), F.col("p_size").cast("long").alias("ratings_count"), F.col("p_brand").alias("work_id"))


def author_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, author_id): distinct part-supplier pairs."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("book_id"), F.col("l_suppkey").cast("string").alias("author_id")).distinct()


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("author_id"), F.col("s_name").alias("author_name"))


def genre_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, genre, n): order priorities and return flags of the part's lines stand in for shelves."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("book_id"), "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    genre = F.explode(F.array(F.col("o_orderpriority"), F.concat(F.lit("flag "), F.col("l_returnflag"))))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("book_id", genre.alias("genre")).groupBy("book_id", "genre").agg(F.count(F.lit(1)).cast("int").alias("n"))


def genre_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, genres map<string, int>)."""
    rows = genre_rows(spark, sf_dir)
    return rows.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("genre", "n")))).alias("genres"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("work_id")).agg(F.min("p_name").alias("original_title"), F.min("p_size").alias("original_publication_year"))


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, ts, event_id from the JSON properties of events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("item_id"), "ts", "event_id")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_index int, input_vector array<double>, label) from embeddings; doubles, so sums agree to the last digits."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("book_index"), F.col("embedding").cast("array<double>").alias("input_vector"), "label")
