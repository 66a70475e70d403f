"""Every query of the engine by name, over the supplied tables in their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.functions import arrays as A
from seqrec.functions import text_time as T
from seqrec.functions import vectors as VX
from seqrec.operators import metadata as M
from seqrec.operators import negatives as N
from seqrec.operators import nextitem as NI
from seqrec.operators import recommend as R
from seqrec.operators import report as RP
from seqrec.operators import sequences as S
from seqrec.operators import similarity as SIM
from seqrec.operators import trainer as TR
from seqrec.operators import vocab as V
from seqrec.plans.lineage import materialize
from seqrec.sources import readers as RD
from seqrec.sources import synthetic as X

#: ``LONGEST`` is the usual bound on a sequence; the two trim queries use a short one, so that it shows.
LONGEST, TRIM, MIN_COUNT, WINDOW = 200, 20, 10, 5
#: Indices beyond the vocabulary that the zero fill is asked for.
SPARE = 10


def _flat(seq: DataFrame, column: str = "book_ids", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Arrays as comma-joined text plus their size, so that results compare across engines."""
    return seq.select(*keys, F.size(column).cast("long").alias("n_items"), F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias("items"))


def _round(x, places: int):
    """Rounded, with no negative zero: engines print it differently."""
    r = F.round(x, places)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return S.user_sequences(S.positive_interactions(X.interactions(spark, d)), X.ORDER)


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("user_id", A.consecutive_dedup(F.col("book_ids")).alias("book_ids"))


def _trimmed(spark: SparkSession, d: str) -> DataFrame:
    return S.min_length(_dedup(spark, d).select("user_id", A.trim_first(F.col("book_ids"), LONGEST).alias("book_ids")))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return S.clean_sequences(X.interactions(spark, d), X.ORDER, trim=LONGEST, least_count=MIN_COUNT)


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seq = materialize(_clean(spark, d), "clean")
    vocab = materialize(V.build_vocabulary(seq), "vocab")
    return V.index_sequences(seq, vocab), vocab


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    names = M.author_names(X.author_links(spark, d), X.authors(spark, d))
    works = X.works(spark, d).select("work_id", F.col("original_title").alias("work_original_title"), F.col("original_publication_year").alias("work_original_publication_year"))
    return M.metadata_lookup(X.books(spark, d), names, M.top_genres(X.genre_maps(spark, d)), works)


def _pos(spark: SparkSession, d: str) -> DataFrame:
    return S.rating_threshold(X.ratings(spark, d)).select("user_id", "book_id").distinct()


def _book_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stand for the first parts: book_id is the vector's number plus 1."""
    return X.item_vectors(spark, d).select((F.col("book_index") + 1).cast("string").alias("book_id"), F.col("input_vector").alias("vector"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return materialize(S.holdout_split(_pos(spark, d)), "split")


def _recs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split, vectors = _split(spark, d), _book_vectors(spark, d)
    train = split.where("NOT is_holdout")
    return split, R.recommend(R.user_profiles(train, vectors), vectors, train)


def _users(spark: SparkSession, d: str) -> DataFrame:
    split, recs = _recs(spark, d)
    return R.evaluate_users(S.item_sets(split.where("is_holdout"), "gt_books"), R.ranked_lists(recs))


# -- filters, casts, sequences ---------------------------------------------------------------


def positive_interactions(spark, d):
    return S.positive_interactions(X.interactions(spark, d)).select("user_id", "book_id", "rating", "l_orderkey", "l_linenumber")


def rating_threshold(spark, d):
    return S.rating_threshold(X.ratings(spark, d))


def dropna_cast(spark, d):
    raw = X.interactions(spark, d).select("user_id", F.when(F.col("is_read") == 1, F.col("book_id")).alias("book_id"), F.when(F.col("rating") > 0, F.col("rating").cast("string")).otherwise("").alias("rating"))
    return RD.dropna_cast(raw)


def user_sequences(spark, d):
    return _flat(_raw(spark, d))


def consecutive_dedup(spark, d):
    return _flat(_dedup(spark, d))


def trim_first(spark, d):
    return _flat(_dedup(spark, d).select("user_id", A.trim_first(F.col("book_ids"), TRIM).alias("book_ids")))


def trim_last(spark, d):
    return _flat(_dedup(spark, d).select("user_id", A.trim_last(F.col("book_ids"), TRIM).alias("book_ids")))


def min_length(spark, d):
    return _flat(S.min_length(_raw(spark, d), 10))


def min_count_tokens(spark, d):
    return S.frequent_tokens(_trimmed(spark, d), MIN_COUNT)


def clean_sequences(spark, d):
    return _flat(_clean(spark, d))


def surviving_ids(spark, d):
    return S.surviving_ids(_clean(spark, d))


# -- metadata ------------------------------------------------------------------------------------


def restrict_books(spark, d):
    return M.restrict(X.books(spark, d), S.surviving_ids(_clean(spark, d))).select("book_id", "title", "work_id")


def author_names(spark, d):
    return M.author_names(X.author_links(spark, d), X.authors(spark, d)).select("book_id", F.array_join("author_names", "|").alias("author_names"))


def author_explode_outer(spark, d):
    nested = X.books(spark, d).join(X.author_links(spark, d).groupBy("book_id").agg(F.collect_list(F.struct("author_id")).alias("authors")), "book_id", "left")
    return M.author_links(nested)


def genre_map(spark, d):
    return X.genre_maps(spark, d).select("book_id", F.explode("genres").alias("genre", "cnt"))


def top_genres(spark, d):
    return M.top_genres(X.genre_maps(spark, d)).select("book_id", F.array_join("top_genres", "|").alias("top_genres"))


def works_join(spark, d):
    return M.referenced_works(X.works(spark, d), X.books(spark, d).where("ratings_count > 25"))


def metadata_lookup(spark, d):
    out = _lookup(spark, d)
    return out.select("book_id", "title", F.array_join("author_names", "|").alias("author_names"), F.array_join("top_genres", "|").alias("top_genres"), "average_rating", "ratings_count", "work_id", "work_original_title", "work_original_publication_year")


def missing_tokens(spark, d):
    return M.missing_metadata(S.surviving_ids(_clean(spark, d)), X.books(spark, d).where("ratings_count <= 40"))


def validation_report(spark, d):
    out = RP.validation_report(materialize(_clean(spark, d), "clean"), X.books(spark, d).where("ratings_count <= 40"))
    return out.select("user_count", "distinct_users", "duplicate_users", "short_sequences", "tokens", "avg_length", "median_length", "max_length", "metadata_coverage.*")


def manifest_counts(spark, d):
    return RP.manifest_counts(materialize(_clean(spark, d), "clean"))


def length_stats(spark, d):
    return RP.length_stats(_raw(spark, d)).withColumn("avg_length", F.round("avg_length", 6))


def coverage(spark, d):
    return RP.coverage(materialize(_clean(spark, d), "clean"), X.books(spark, d).where("ratings_count <= 30"))


# -- vocabulary, pairs, negatives --------------------------------------------------------------


def vocabulary(spark, d):
    return V.build_vocabulary(_clean(spark, d)).select("book_id", F.col("book_index").cast("long").alias("book_index"))


def index_sequences(spark, d):
    return _flat(_indexed(spark, d)[0], "book_indices")


def _pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("target_book_index", "context_book_index").agg(F.count(F.lit(1)).alias("n")).select(F.col("target_book_index").cast("long").alias("target_book_index"), F.col("context_book_index").cast("long").alias("context_book_index"), "n")


def training_pairs_native(spark, d):
    return _pair_counts(V.training_pairs(_indexed(spark, d)[0], WINDOW))


def training_pairs_selfjoin(spark, d):
    return _pair_counts(V.training_pairs_selfjoin(_indexed(spark, d)[0], WINDOW))


def pair_count(spark, d):
    return _clean(spark, d).select("user_id", F.size("book_ids").cast("long").alias("n_items"), A.pair_count(F.size("book_ids"), WINDOW).alias("n_pairs"))


def total_pairs(spark, d):
    return V.total_pairs(_clean(spark, d), WINDOW, "book_ids")


def token_counts(spark, d):
    return N.token_counts(_indexed(spark, d)[0]).select(F.col("book_index").cast("long").alias("book_index"), "cnt")


def zero_count_fill(spark, d):
    indexed, vocab = _indexed(spark, d)
    return N.zero_filled_counts(spark, N.token_counts(indexed), vocab.count() + SPARE)


def negative_distribution(spark, d):
    indexed, vocab = _indexed(spark, d)
    return N.negative_distribution(spark, materialize(indexed, "indexed"), vocab.count()).select("book_index", F.round("probability", 9).alias("probability"))


def alias_table(spark, d):
    """The alias table's own probabilities, rebuilt from its cells: equal to the distribution."""
    import numpy as np

    indexed, vocab = _indexed(spark, d)
    p = N.negative_distribution(spark, materialize(indexed, "indexed"), vocab.count()).orderBy("book_index").toPandas()
    prob, alias = N.alias_table(p["probability"].to_numpy())
    back = np.bincount(np.arange(len(prob)), prob, len(prob)) + np.bincount(alias, 1 - prob, len(prob))
    return spark.createDataFrame(list(zip(p["book_index"].tolist(), (back / len(prob)).tolist(), strict=True)), "book_index long, probability double").select("book_index", F.round("probability", 9).alias("probability"))


def epoch_pairs(spark, d):
    indexed = materialize(_indexed(spark, d)[0], "indexed")
    fractions = V.epoch_fractions(V.total_pairs(indexed, WINDOW).first()[0], indexed.count(), 5000)
    return V.epoch_pairs(indexed, WINDOW, fractions, 1, 5000)


def sample_negatives(spark, d):
    indexed, vocab = _indexed(spark, d)
    indexed = materialize(indexed, "indexed")
    fractions = V.epoch_fractions(V.total_pairs(indexed, WINDOW).first()[0], indexed.count(), 2000)
    return N.sample_negatives(V.epoch_pairs(indexed, WINDOW, fractions, 1, 2000), N.negative_distribution(spark, indexed, vocab.count()))


def init_embeddings(spark, d):
    return TR.init_embeddings(V.build_vocabulary(_clean(spark, d)), 16)


# -- training ------------------------------------------------------------------------------------


def _fixed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with fixed negatives over the supplied vectors: order keys deal target, context and negatives."""
    lines = X.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    vectors = X.item_vectors(spark, d).count()
    spot = lambda x: F.pmod(x, F.lit(vectors)).cast("int")
    return lines.select(spot(F.col("l_orderkey")).alias("target_book_index"), spot(F.col("l_partkey")).alias("context_book_index"), F.array(spot(F.col("l_partkey") * 7 + 3), spot(F.col("l_suppkey") * 11 + 5)).alias("negatives"))


def _model(spark: SparkSession, d: str) -> DataFrame:
    v = X.item_vectors(spark, d).select("book_index", F.col("input_vector").cast("array<double>").alias("input_vector"))
    return v.select("book_index", "input_vector", F.reverse("input_vector").alias("output_vector"))


def sgns_gradients(spark, d):
    g = TR.sgns_gradients(_fixed_pairs(spark, d), _model(spark, d))
    return g.select("kind", F.col("book_index").cast("long").alias("book_index"), _round(F.aggregate("g", F.lit(0.0), lambda s, x: s + x), 5).alias("g_sum"), F.round(VX.norm(F.col("g")), 5).alias("g_norm"))


def sgd_step(spark, d):
    model = _model(spark, d)
    out = TR.sgd_step(model, TR.sgns_gradients(_fixed_pairs(spark, d), model, combine=False), 0.025)
    total = lambda c: _round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 5)
    return out.select(F.col("book_index").cast("long").alias("book_index"), total("input_vector").alias("in_sum"), total("output_vector").alias("out_sum"))


def train_sgns(spark, d):
    model, vocab = TR.train_sgns(_clean(spark, d), dim=16, epochs=2, max_pairs=20_000)
    return TR.book_embeddings(model, vocab)


def train_ml_word2vec(spark, d):
    return TR.train_ml_word2vec(S.random_sentences(_pos(spark, d)), dim=16, iterations=1)


# -- vectors and similarity ----------------------------------------------------------------------


def norm_stats(spark, d):
    out = SIM.norm_stats(X.item_vectors(spark, d))
    return out.select("total", F.col("dim").cast("long").alias("dim"), *[F.round(c, 6).alias(c) for c in ("min_norm", "avg_norm", "max_norm")])


def normalize_vectors(spark, d):
    return SIM.normalized(X.item_vectors(spark, d)).select(F.col("book_index").cast("long").alias("book_index"), F.posexplode("unit").alias("i", "x")).select("book_index", F.col("i").cast("long").alias("i"), _round(F.col("x"), 6).alias("x"))


def cosine_topk(spark, d):
    return SIM.similar_items(X.item_vectors(spark, d), 7, 5).select(F.col("book_index").cast("long").alias("book_index"), _round(F.col("similarity"), 6).alias("similarity"))


def cosine_topk_batch(spark, d):
    v = X.item_vectors(spark, d)
    out = SIM.cosine_topk(v, v.where("book_index % 25 = 0").select("book_index"), 5)
    return out.select(F.col("query_id").cast("long").alias("query_id"), F.col("book_index").cast("long").alias("book_index"), _round(F.col("similarity"), 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def lsh_topk(spark, d):
    v = X.item_vectors(spark, d)
    return SIM.lsh_topk(v, v.where("book_index % 50 = 0").select("book_index"), 5)


def vector_sum(spark, d):
    out = VX.vector_agg(X.item_vectors(spark, d), ["label"], "input_vector")
    return out.select(F.col("label").cast("long").alias("label"), F.posexplode("input_vector").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), _round(F.col("x"), 5).alias("x"))


def vector_mean(spark, d):
    out = VX.vector_agg(X.item_vectors(spark, d), ["label"], "input_vector", "avg")
    return out.select(F.col("label").cast("long").alias("label"), F.posexplode("input_vector").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), _round(F.col("x"), 6).alias("x"))


def similarity_report(spark, d):
    v = X.item_vectors(spark, d)
    meta = X.table(spark, d, "part").where("p_size > 10").select((F.col("p_partkey") - 1).cast("int").alias("book_index"), F.col("p_name").alias("title"))
    out = SIM.similarity_report(SIM.cosine_topk(v, v.where("book_index % 50 = 0").select("book_index"), 5), meta)
    return out.select(F.col("query_id").cast("long").alias("query_id"), "query_title", F.col("rank").cast("long").alias("rank"), F.col("book_index").cast("long").alias("book_index"), "title")


def random_sample(spark, d):
    return SIM.random_items(X.item_vectors(spark, d), 12).select(F.col("book_index").cast("long").alias("book_index"))


# -- titles ----------------------------------------------------------------------------------------


def _first_title(spark: SparkSession, d: str) -> str:
    return X.books(spark, d).agg(F.min("title")).first()[0]


def resolve_title_exact(spark, d):
    title = _first_title(spark, d)
    return M.resolve_titles(X.books(spark, d), [title.upper(), "", "no such title"]).select("book_id", "title")


def resolve_title_partial(spark, d):
    title = _first_title(spark, d)
    return M.resolve_titles(X.books(spark, d), [title[1:].upper()]).select("book_id", "title")


def title_lookup(spark, d):
    ids = spark.createDataFrame([(str(i),) for i in (1, 5, 42, 10**7)], "book_id string")
    return M.with_labels(ids, M.titles_of(X.books(spark, d), ["1", "5", "42", "5", None])).select("book_id", "label")


# -- recommendation and evaluation ----------------------------------------------------------------


def dedup_pairs(spark, d):
    return S.dedup_pairs(X.interactions(spark, d), ["user_id", "book_id"], X.ORDER).select("user_id", "book_id", "l_orderkey", "l_linenumber", "rating")


def holdout_split(spark, d):
    return S.holdout_split(_pos(spark, d))


def random_sentences(spark, d):
    return _flat(S.random_sentences(_pos(spark, d)), "sentence")


def ground_truth_sets(spark, d):
    return _flat(S.item_sets(_split(spark, d).where("is_holdout"), "b"), "b")


def seen_sets(spark, d):
    return _flat(S.item_sets(_split(spark, d).where("NOT is_holdout"), "b"), "b")


def user_profiles(spark, d):
    out = R.user_profiles(_split(spark, d).where("NOT is_holdout"), _book_vectors(spark, d))
    return out.select("user_id", F.posexplode("profile").alias("i", "x")).select("user_id", F.col("i").cast("long").alias("i"), _round(F.col("x"), 6).alias("x"))


def score_all(spark, d):
    """Scores of all users against all items."""
    vectors = _book_vectors(spark, d)
    profiles = R.user_profiles(_split(spark, d).where("NOT is_holdout"), vectors)
    return R.score_all(profiles, vectors).select("user_id", "book_id", "score")


def unseen_topk(spark, d):
    return _recs(spark, d)[1].select("user_id", "book_id", _round(F.col("score"), 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def recs_pretty(spark, d):
    out = R.pretty(R.ranked_lists(_recs(spark, d)[1]), X.books(spark, d).select("book_id", "title"))
    return out.select("user_id", F.col("pos").cast("long").alias("pos"), "book_id", "title")


def precision_recall_at_10(spark, d):
    return R.summarize(_users(spark, d)).select("users", F.round("precision", 6).alias("precision_at_10"), F.round("recall", 6).alias("recall_at_10"))


def hit_at_k(spark, d):
    return R.summarize(_users(spark, d)).select("users", F.round("hit", 6).alias("hit_at_10"))


def ndcg_at_k(spark, d):
    return R.summarize(_users(spark, d)).select("users", F.round("ndcg", 6).alias("ndcg_at_10"))


# -- next item -------------------------------------------------------------------------------------


def parse_read_at(spark, d):
    """Times written as text and read back; every seventh row's text is broken."""
    ts = X.timed_events(spark, d)
    text = F.concat(F.lit("Sun "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" -0700 "), F.date_format("ts", "yyyy"))
    shown = ts.select("event_id", F.when(F.col("event_id") % 7 == 0, "garbled").otherwise(text).alias("read_at"))
    return shown.select("event_id", F.date_format(T.parse_read_at(F.col("read_at")), "yyyy-MM-dd HH:mm:ss").alias("read_at"))


def min_history(spark, d):
    return S.min_history(X.timed_events(spark, d), 8).select("user_id", "item_id", "event_id")


def k_core(spark, d):
    pairs = X.interactions(spark, d).select("user_id", F.col("book_id").alias("item_id")).distinct()
    return S.k_core(pairs, 5)


def first_appearance_ids(spark, d):
    return M.first_appearance_ids(X.timed_events(spark, d), "item_id", ["ts", "event_id"]).select("item_id", F.col("idx").cast("long").alias("idx"))


def _event_sequences(spark: SparkSession, d: str) -> DataFrame:
    return NI.time_sequences(X.timed_events(spark, d), ["ts", "event_id"], 5)[0]


def time_sequences(spark, d):
    return _flat(_event_sequences(spark, d).withColumn("user_idx", F.col("user_idx").cast("long")), "items", ("user_idx",))


def pad_truncate(spark, d):
    seq = _event_sequences(spark, d)
    return _flat(seq.select(F.col("user_idx").cast("long").alias("user_idx"), A.left_pad(F.col("items"), 50).alias("p")), "p", ("user_idx",))


def shifted_targets(spark, d):
    rows = NI.training_rows(_event_sequences(spark, d))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select(F.col("user_idx").cast("long").alias("user_idx"), text("inputs").alias("inputs"), text("targets").alias("targets"))


def leave_one_out(spark, d):
    return S.leave_one_out(X.timed_events(spark, d), ["ts", "event_id"]).select("event_id", "split")


def reject_negatives(spark, d):
    return NI.reject_negatives(NI.training_rows(_event_sequences(spark, d)), 200)


def next_item_scores(spark, d):
    return NI.next_items(_event_sequences(spark, d), NI.init_weights(100, hidden=32))


QUERIES = {
    f.__name__: f
    for f in (
        positive_interactions, rating_threshold, dropna_cast, user_sequences, consecutive_dedup, trim_first, trim_last, min_length, min_count_tokens, clean_sequences, surviving_ids,
        restrict_books, author_names, author_explode_outer, genre_map, top_genres, works_join, metadata_lookup, missing_tokens, validation_report, manifest_counts, length_stats, coverage,
        vocabulary, index_sequences, training_pairs_native, training_pairs_selfjoin, pair_count, total_pairs, token_counts, zero_count_fill, negative_distribution, alias_table, epoch_pairs, sample_negatives, init_embeddings,
        sgns_gradients, sgd_step, train_sgns, train_ml_word2vec,
        norm_stats, normalize_vectors, cosine_topk, cosine_topk_batch, lsh_topk, vector_sum, vector_mean, similarity_report, random_sample,
        resolve_title_exact, resolve_title_partial, title_lookup,
        dedup_pairs, holdout_split, random_sentences, ground_truth_sets, seen_sets, user_profiles, score_all, unseen_topk, recs_pretty, precision_recall_at_10, hit_at_k, ndcg_at_k,
        parse_read_at, min_history, k_core, first_appearance_ids, time_sequences, pad_truncate, shifted_targets, leave_one_out, reject_negatives, next_item_scores,
    )
}
