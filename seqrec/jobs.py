"""Whole jobs: preprocessing, training, similarity, recommendation with evaluation, next-item preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.operators import metadata as M
from seqrec.operators import nextitem as NI
from seqrec.operators import recommend as R
from seqrec.operators import report as RP
from seqrec.operators import sequences as S
from seqrec.operators import similarity as SIM
from seqrec.operators import trainer as TR
from seqrec.plans.lineage import materialize
from seqrec.sources import readers as RD
from seqrec.sources import writers as W


def preprocess(spark: SparkSession, sources: dict[str, str], out: str, trim: int = 200, keep: str = "first", min_count: int = 10) -> dict:
    """Interactions and JSON metadata to ``user_sequences/``, ``book_metadata_lookup/``, manifest and validation report.

    ``sources`` names interactions (CSV), books, authors, genres and works (JSON lines). Without an order column in
    the CSV, a user's order is the file order. Returns the manifest.
    """
    out = out.rstrip("/")
    rows = RD.read_interactions_csv(spark, sources["interactions"]).withColumn("_file", F.input_file_name()).withColumn("_row", F.monotonically_increasing_id())
    seq = S.clean_sequences(rows, ["_file", "_row"], trim, keep, min_count)
    W.write_parquet(seq, f"{out}/user_sequences")
    seq = spark.read.parquet(f"{out}/user_sequences")
    ids = materialize(S.surviving_ids(seq), "ids")
    books = M.restrict(M.typed_books(RD.read_json_lines(spark, sources["books"], "books")), ids)
    authors = RD.read_json_lines(spark, sources["authors"], "authors").withColumnRenamed("name", "author_name")
    genres = M.restrict(RD.read_json_lines(spark, sources["genres"], "genres"), ids)
    works = M.referenced_works(RD.read_json_lines(spark, sources["works"], "works"), books)
    lookup = M.metadata_lookup(books, M.author_names(M.author_links(books), authors), M.top_genres(genres), works)
    W.write_parquet(lookup, f"{out}/book_metadata_lookup")
    outputs = {k: f"{out}/{k}" for k in ("user_sequences", "book_metadata_lookup")}
    manifest = RP.manifest(seq, sources, outputs, trim, min_count)
    W.write_json_artifact(spark, f"{out}/manifest.json", manifest)
    W.write_json_artifact(spark, f"{out}/validation_report.json", RP.validation_report(seq, spark.read.parquet(f"{out}/book_metadata_lookup")))
    return manifest


def train(spark: SparkSession, sequences: str, model: str, **how) -> None:
    """Train on a sequence table and save the model."""
    embeddings, vocab = TR.train_sgns(RD.load_user_sequences(spark, sequences), **how)
    W.save_model(embeddings, vocab, model)


def similar(spark: SparkSession, model: str, ids: list[str] = (), titles: list[str] = (), random_samples: int = 0, k: int = 5, metadata: str | None = None) -> DataFrame:
    """Neighbours of books given by id, title or seeded sampling; unknown ones give no rows."""
    books = materialize(RD.load_model(spark, model)[2], "books")
    names = RD.load_metadata_lookup(spark, metadata)
    wanted = spark.createDataFrame([(str(i),) for i in dict.fromkeys(ids)], "book_id string").unionByName(SIM.random_items(books, random_samples, "book_id"))
    if names is not None and titles:
        wanted = wanted.unionByName(M.resolve_titles(names, list(titles)).select("book_id"))
    return SIM.similarity_table(books, wanted.distinct(), names, k)


def recommend_and_evaluate(ratings: DataFrame, k: int = 10, fit_on: str = "all", **how) -> tuple[DataFrame, DataFrame]:
    """(recommendations, one-row metrics) from (user_id, book_id, rating).

    ``fit_on='all'`` fits vectors on all positives; ``'train'`` keeps the held-out items out of the fit.
    """
    pos = materialize(S.rating_threshold(RD.dropna_cast(ratings)).select("user_id", "book_id").distinct(), "positives")
    split = materialize(S.holdout_split(pos), "split")
    train_rows = split.where("NOT is_holdout").select("user_id", "book_id")
    vectors = materialize(TR.train_ml_word2vec(S.random_sentences(pos if fit_on == "all" else train_rows), **how), "vectors")
    recs = materialize(R.recommend(R.user_profiles(train_rows, vectors), vectors, train_rows, k), "recs")
    truth = S.item_sets(split.where("is_holdout"), "gt_books")
    return recs, R.summarize(R.evaluate_users(truth, R.ranked_lists(recs), k))


def prepare_next_item(spark: SparkSession, reviews: str, out: str, least: int = 5) -> None:
    """Reviews (JSON lines) to the next-item dataset: sequences and both id maps."""
    rows = NI.timed_reviews(RD.read_json_lines(spark, reviews, "reviews"))
    NI.save_dataset(*NI.time_sequences(rows, ["ts"], least), out)
