"""Item metadata: authors, genres, works, title resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.functions.text_time import label
from seqrec.plans.lineage import small_side

COLUMNS = ["book_id", "title", "title_without_series", "author_names", "top_genres", "average_rating", "ratings_count", "publication_year", "series_ids", "work_id", "work_original_title", "work_original_publication_year"]


def restrict(df: DataFrame, ids: DataFrame, key: str = "book_id") -> DataFrame:
    """Rows whose key is in ``ids``: a semi join, sent to every executor only if its counted size allows."""
    return df.join(small_side(ids.select(key)), key, "left_semi")


def typed_books(raw: DataFrame) -> DataFrame:
    """Books as read from JSON with numbers cast leniently; empty or malformed text gives null."""
    return raw.select(
        F.col("book_id").cast("string").alias("book_id"), "title", "title_without_series",
        F.col("average_rating").try_cast("double").alias("average_rating"), F.col("ratings_count").try_cast("long").alias("ratings_count"),
        F.col("publication_year").try_cast("int").alias("publication_year"), F.col("work_id").cast("string").alias("work_id"),
        F.col("series").alias("series_ids"), "authors",
    )


def author_links(books: DataFrame) -> DataFrame:
    """(book_id, author_id) from the nested authors; a book without authors keeps one row with null."""
    return books.select("book_id", F.explode_outer("authors").alias("_a")).select("book_id", F.col("_a.author_id").cast("string").alias("author_id"))


def author_names(links: DataFrame, authors: DataFrame) -> DataFrame:
    """(book_id, author_names): sorted distinct names; unknown authors are left out."""
    named = links.join(small_side(authors.select("author_id", "author_name")), "author_id", "left")
    return named.groupBy("book_id").agg(F.array_sort(F.collect_set("author_name")).alias("author_names"))


def top_genres(genres: DataFrame, n: int = 5) -> DataFrame:
    """(book_id, top_genres) from maps: highest counts first, ties by name; books with an empty map vanish."""
    rows = genres.select("book_id", F.explode("genres").alias("genre", "cnt"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), F.col("genre").alias("g")))), lambda x: x["g"])
    return rows.groupBy("book_id").agg(F.slice(ranked, 1, n).alias("top_genres"))


def referenced_works(works: DataFrame, books: DataFrame) -> DataFrame:
    used = books.where("work_id IS NOT NULL").select("work_id").distinct()
    return works.select(F.col("work_id").cast("string").alias("work_id"), F.col("original_title").alias("work_original_title"), F.col("original_publication_year").try_cast("int").alias("work_original_publication_year")).join(small_side(used), "work_id", "left_semi")


def metadata_lookup(books: DataFrame, names: DataFrame, genres: DataFrame, works: DataFrame) -> DataFrame:
    """One row per book with whatever metadata exists; columns missing in the input are null."""
    out = books.join(names, "book_id", "left").join(genres, "book_id", "left").join(small_side(works), "work_id", "left")
    have = dict(out.dtypes)
    kinds = {"title_without_series": "string", "publication_year": "int", "series_ids": "array<string>"}
    return out.select(*[F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS])


def resolve_titles(metadata: DataFrame, titles: list[str]) -> DataFrame:
    """(query, book_id, title): exact match without case, else substring; shortest title, then smallest id.

    Blank queries and queries without a match give no row.
    """
    asked = [t.strip() for t in titles if t and t.strip()]
    spark = metadata.sparkSession
    query = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "_q int, query string")
    low, q = F.lower("title"), F.lower("query")
    # the queries are a short list by nature, so every title meets them in one pass without a shuffle
    hit = metadata.select("book_id", "title").join(F.broadcast(query), low.contains(q))
    tier = F.when(low == q, 0).otherwise(1)
    best = hit.groupBy("_q", "query").agg(F.min(F.struct(tier.alias("tier"), F.length("title").alias("len"), "book_id", "title")).alias("m"))
    return best.select("query", F.col("m.book_id").alias("book_id"), F.col("m.title").alias("title"))


def titles_of(metadata: DataFrame, ids: list[str]) -> DataFrame:
    """(book_id, title) of listed ids, without repeats and nulls."""
    wanted = sorted({str(i) for i in ids if i is not None})
    return metadata.where(F.col("book_id").isin(wanted)).select("book_id", "title")


def with_labels(df: DataFrame, metadata: DataFrame) -> DataFrame:
    return df.join(metadata.select("book_id", "title"), "book_id", "left").withColumn("label", label(F.col("title"), F.col("book_id")))


def missing_metadata(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    return ids.join(metadata.select("book_id").distinct(), "book_id", "left_anti")


def first_appearance_ids(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(column, idx): 1-based dense ids in order of first appearance; 0 is left for padding."""
    from seqrec.operators.sequences import with_row_index

    firsts = df.groupBy(column).agg(F.min(F.struct(*order)).alias("_o"))
    keyed = firsts.select(column, *[F.col(f"_o.{c}").alias(f"_k{i}") for i, c in enumerate(order)])
    return with_row_index(keyed, [f"_k{i}" for i in range(len(order))] + [column]).select(column, (F.col("row_index") + 1).cast("int").alias("idx"))


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """0-based index in order of ``column`` through one window: for tables known to be small."""
    return df.withColumn("idx", F.row_number().over(Window.orderBy(column)) - 1)
