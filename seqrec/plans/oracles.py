"""DuckDB twins of the catalogue's queries, built from shared common table expressions."""

from __future__ import annotations

def rounded(x: str, places: int) -> str:
    """Rounded, with no negative zero."""
    return f"CASE WHEN round({x}, {places}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {places}) END"


INTER = """inter AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS book_id, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS is_read,
    CAST(floor(l_quantity / 10) AS INT) AS rating, o_orderdate AS ts, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
KEY = "ts, l_orderkey, l_linenumber, l_partkey"
RAW = f"{INTER}, raw AS (SELECT user_id, list(book_id ORDER BY {KEY}) AS ids FROM inter WHERE is_read = 1 AND rating > 0 GROUP BY user_id)"
DEDUP = f"{RAW}, dd AS (SELECT user_id, list_filter(ids, lambda x, i: i = 1 OR x <> ids[i - 1]) AS ids FROM raw)"
TRIMMED = f"{DEDUP}, tr AS (SELECT user_id, ids[1:200] AS ids FROM dd WHERE len(ids) >= 2)"
TOKENS = f"{TRIMMED}, cnt AS (SELECT book_id, count(*) AS cnt FROM (SELECT unnest(ids) AS book_id FROM tr) GROUP BY book_id HAVING count(*) >= 10)"
CLEAN = f"""{TOKENS}, pos AS (SELECT user_id, unnest(ids) AS book_id, generate_subscripts(ids, 1) AS p FROM tr),
    clean AS (SELECT user_id, list(book_id ORDER BY p) AS ids FROM pos JOIN cnt USING (book_id) GROUP BY user_id HAVING count(*) >= 2)"""
VOCAB = f"""{CLEAN}, ids AS (SELECT DISTINCT unnest(ids) AS book_id FROM clean), vocab AS (SELECT book_id, row_number() OVER (ORDER BY book_id) - 1 AS book_index FROM ids)"""
INDEXED = f"""{VOCAB}, ci AS (SELECT user_id, p, book_index FROM (SELECT user_id, unnest(ids) AS book_id, generate_subscripts(ids, 1) AS p FROM clean) JOIN vocab USING (book_id))"""
FLAT = "SELECT user_id, len(ids) AS n_items, array_to_string(ids, ',') AS items FROM"
PAIRS = f"WITH {INDEXED} SELECT a.book_index AS target_book_index, b.book_index AS context_book_index, count(*) AS n FROM ci a JOIN ci b USING (user_id) WHERE abs(a.p - b.p) <= 5 AND a.p <> b.p GROUP BY ALL"
PROB = f"""WITH {INDEXED}, w AS (SELECT book_index, pow(count(*), 0.75) AS w FROM ci GROUP BY book_index) SELECT book_index, round(w / sum(w) OVER (), 9) AS probability FROM w"""

BOOKS = "books AS (SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, p_retailprice AS average_rating, CAST(p_size AS BIGINT) AS ratings_count, p_brand AS work_id FROM part)"
LINKS = "links AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS book_id, CAST(l_suppkey AS VARCHAR) AS author_id FROM lineitem)"
NAMES = f"{LINKS}, names AS (SELECT book_id, array_to_string(list_sort(list(DISTINCT s_name)), '|') AS author_names FROM links LEFT JOIN supplier ON author_id = CAST(s_suppkey AS VARCHAR) GROUP BY book_id)"
GENRES = """g0 AS (SELECT CAST(l_partkey AS VARCHAR) AS book_id, unnest([o_orderpriority, 'flag ' || l_returnflag]) AS genre FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    genres AS (SELECT book_id, genre, CAST(count(*) AS INT) AS cnt FROM g0 GROUP BY ALL)"""
TOP = f"{GENRES}, top AS (SELECT book_id, array_to_string(list(genre ORDER BY cnt DESC, genre)[1:5], '|') AS top_genres FROM genres GROUP BY book_id)"
WORKS = "works AS (SELECT p_brand AS work_id, min(p_name) AS work_original_title, min(p_size) AS work_original_publication_year FROM part GROUP BY p_brand)"

VEC = "vec AS (SELECT vec_id AS book_index, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
UNIT = f"{VEC}, unit AS (SELECT book_index, list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END) AS u FROM vec)"
NEAR = f"""near AS (SELECT q.book_index AS query_id, i.book_index, {rounded('list_inner_product(i.u, q.u)', 6)} AS similarity FROM unit i, unit q WHERE q.book_index % {{step}} = 0 AND i.book_index <> q.book_index),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, book_index) AS rank FROM near QUALIFY rank <= 5)"""

POS = f"{INTER}, pos AS (SELECT DISTINCT user_id, book_id FROM inter WHERE rating >= 3)"
SPLIT = f"""{POS}, sp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('43:' || user_id || ':' || book_id), book_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY user_id) / 5)) AS is_holdout FROM pos)"""
BV = "bv AS (SELECT CAST(vec_id + 1 AS VARCHAR) AS book_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
PROFILE = f"""{SPLIT}, {BV}, cell AS (SELECT user_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM sp JOIN bv USING (book_id) WHERE NOT is_holdout),
    prof AS (SELECT user_id, i, avg(x) AS x FROM cell GROUP BY ALL), profile AS (SELECT user_id, list(x ORDER BY i) AS p FROM prof GROUP BY user_id)"""
SCORE = rounded("coalesce(list_inner_product(p, v) / nullif(sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(v, v)), 0), 0)", 6)
RECS = f"""{PROFILE}, sc AS (SELECT user_id, book_id, {SCORE} AS score FROM profile, bv),
    recs AS (SELECT sc.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS rank FROM sc ANTI JOIN (SELECT * FROM sp WHERE NOT is_holdout) s USING (user_id, book_id) QUALIFY rank <= 10)"""
EVAL = f"""{RECS}, gt AS (SELECT user_id, count(*) AS n FROM sp WHERE is_holdout GROUP BY user_id), got AS (SELECT DISTINCT user_id FROM recs JOIN gt USING (user_id)),
    hit AS (SELECT r.user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM recs r JOIN sp ON sp.user_id = r.user_id AND sp.book_id = r.book_id AND is_holdout GROUP BY r.user_id),
    ideal AS (SELECT m, sum(1 / log2(k + 1)) AS idcg FROM range(1, 11) t(m), range(1, 11) s(k) WHERE k <= m GROUP BY m),
    ev AS (SELECT user_id, coalesce(hits, 0) AS hits, n, coalesce(dcg, 0) / idcg AS ndcg FROM got JOIN gt USING (user_id) LEFT JOIN hit USING (user_id) JOIN ideal ON m = least(10, n))"""

EV = "e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, ts, event_id FROM events)"
SEQ = f"""{EV}, one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) = 1),
    kept AS (SELECT * FROM one QUALIFY count(*) OVER (PARTITION BY user_id) >= 5),
    ui AS (SELECT user_id, row_number() OVER (ORDER BY min(ROW(ts, event_id)), user_id) AS user_idx FROM kept GROUP BY user_id),
    ii AS (SELECT item_id, row_number() OVER (ORDER BY min(ROW(ts, event_id)), item_id) AS item_idx FROM kept GROUP BY item_id),
    seq AS (SELECT user_idx, list(item_idx ORDER BY ts, event_id) AS ids FROM kept JOIN ui USING (user_id) JOIN ii USING (item_id) GROUP BY user_idx)"""
PAD = "list_concat(list_transform(range(greatest(50 - len({0}), 0)), lambda i: CAST(0 AS BIGINT)), {0})"

SPOTS = """nv AS (SELECT count(*) AS k FROM embeddings),
    fp AS (SELECT l_orderkey % k AS t, l_partkey % k AS c, [(l_partkey * 7 + 3) % k, (l_suppkey * 11 + 5) % k] AS n FROM lineitem, nv),
    m AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS u, list_reverse(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
    ex AS (SELECT t, c AS o, 1.0 AS y FROM fp UNION ALL SELECT t, unnest(n), 0.0 FROM fp),
    gr AS (SELECT t, o, a.u AS u, b.v AS v, 1 / (1 + exp(-list_inner_product(a.u, b.v))) - y AS c FROM ex JOIN m a ON a.i = t JOIN m b ON b.i = o),
    cells AS (SELECT 'input' AS kind, t AS i, generate_subscripts(v, 1) AS k, c * unnest(v) AS x FROM gr UNION ALL SELECT 'output', o, generate_subscripts(u, 1), c * unnest(u) FROM gr),
    g AS (SELECT kind, i, k, sum(x) AS x FROM cells GROUP BY ALL)"""


def _clean_coverage(limit: int) -> str:
    return f"""(SELECT count(*) AS vocabulary_size, count(*) FILTER (b.book_id IS NULL) AS missing, count(b.book_id) AS covered,
        round(coalesce(100.0 * count(b.book_id) / nullif(count(*), 0), 0), 4) AS coverage_pct FROM ids LEFT JOIN (SELECT DISTINCT book_id FROM books WHERE ratings_count <= {limit}) b USING (book_id))"""


FIRST_TITLE = "(SELECT min(title) FROM books)"

ORACLES = {
    "positive_interactions": f"WITH {INTER} SELECT user_id, book_id, rating, l_orderkey, l_linenumber FROM inter WHERE is_read = 1 AND rating > 0",
    "rating_threshold": f"WITH {INTER} SELECT user_id, book_id, CAST(rating AS DOUBLE) AS rating FROM inter WHERE rating >= 3",
    "dropna_cast": f"WITH {INTER} SELECT user_id, book_id, CAST(rating AS DOUBLE) AS rating FROM inter WHERE is_read = 1 AND rating > 0",
    "user_sequences": f"WITH {RAW} {FLAT} raw",
    "consecutive_dedup": f"WITH {DEDUP} {FLAT} dd",
    "trim_first": f"WITH {DEDUP}, t AS (SELECT user_id, ids[1:20] AS ids FROM dd) {FLAT} t",
    "trim_last": f"WITH {DEDUP}, t AS (SELECT user_id, ids[-20:] AS ids FROM dd) {FLAT} t",
    "min_length": f"WITH {RAW} {FLAT} raw WHERE len(ids) >= 10",
    "min_count_tokens": f"WITH {TOKENS} SELECT book_id, cnt FROM cnt",
    "clean_sequences": f"WITH {CLEAN} {FLAT} clean",
    "surviving_ids": f"WITH {CLEAN} SELECT DISTINCT unnest(ids) AS book_id FROM clean",
    "restrict_books": f"WITH {VOCAB}, {BOOKS} SELECT book_id, title, work_id FROM books SEMI JOIN ids USING (book_id)",
    "author_names": f"WITH {NAMES} SELECT book_id, author_names FROM names",
    "author_explode_outer": f"WITH {BOOKS}, {LINKS} SELECT book_id, author_id FROM books LEFT JOIN links USING (book_id)",
    "genre_map": f"WITH {GENRES} SELECT book_id, genre, cnt FROM genres",
    "top_genres": f"WITH {TOP} SELECT book_id, top_genres FROM top",
    "works_join": f"WITH {BOOKS}, {WORKS} SELECT work_id, work_original_title, work_original_publication_year FROM works SEMI JOIN (SELECT * FROM books WHERE ratings_count > 25) b USING (work_id)",
    "metadata_lookup": f"WITH {BOOKS}, {NAMES}, {TOP}, {WORKS} SELECT book_id, title, author_names, top_genres, average_rating, ratings_count, work_id, work_original_title, work_original_publication_year FROM books LEFT JOIN names USING (book_id) LEFT JOIN top USING (book_id) LEFT JOIN works USING (work_id)",
    "missing_tokens": f"WITH {VOCAB}, {BOOKS} SELECT book_id FROM ids ANTI JOIN (SELECT book_id FROM books WHERE ratings_count <= 40) b USING (book_id)",
    "validation_report": f"""WITH {VOCAB}, {BOOKS} SELECT count(*) AS user_count, count(DISTINCT user_id) AS distinct_users, count(*) - count(DISTINCT user_id) AS duplicate_users, count(*) FILTER (len(ids) < 2) AS short_sequences,
        CAST(sum(len(ids)) AS BIGINT) AS tokens, round(avg(len(ids)), 4) AS avg_length, quantile_disc(len(ids), 0.5) AS median_length, max(len(ids)) AS max_length,
        max(vocabulary_size) AS vocabulary_size, max(covered) AS covered, max(missing) AS missing, max(coverage_pct) AS coverage_pct FROM clean, {_clean_coverage(40)}""",
    "manifest_counts": f"WITH {VOCAB} SELECT (SELECT count(*) FROM clean) AS user_count, (SELECT count(*) FROM ids) AS vocabulary_size",
    "length_stats": f"WITH {RAW} SELECT CAST(sum(len(ids)) AS BIGINT) AS tokens, round(avg(len(ids)), 6) AS avg_length, quantile_disc(len(ids), 0.5) AS median_length, max(len(ids)) AS max_length FROM raw",
    "coverage": f"WITH {VOCAB}, {BOOKS} SELECT vocabulary_size, missing, covered, coverage_pct FROM {_clean_coverage(30)}",
    "vocabulary": f"WITH {VOCAB} SELECT book_id, book_index FROM vocab",
    "index_sequences": f"WITH {INDEXED} SELECT user_id, count(*) AS n_items, string_agg(CAST(book_index AS VARCHAR), ',' ORDER BY p) AS items FROM ci GROUP BY user_id",
    "training_pairs_native": PAIRS,
    "training_pairs_selfjoin": PAIRS,
    "pair_count": f"WITH {CLEAN}, c AS (SELECT user_id, len(ids) AS n, least(5, len(ids) - 1) AS m FROM clean) SELECT user_id, n AS n_items, CASE WHEN n > 1 THEN 2 * m * n - m * (m + 1) ELSE 0 END AS n_pairs FROM c",
    "total_pairs": f"WITH {INDEXED} SELECT count(*) AS total_pairs FROM ci a JOIN ci b USING (user_id) WHERE abs(a.p - b.p) <= 5 AND a.p <> b.p",
    "token_counts": f"WITH {INDEXED} SELECT book_index, count(*) AS cnt FROM ci GROUP BY book_index",
    "zero_count_fill": f"WITH {INDEXED} SELECT r.range AS book_index, count(ci.book_index) AS cnt FROM (SELECT unnest(range(count(*) + 10)) AS range FROM vocab) r LEFT JOIN ci ON ci.book_index = r.range GROUP BY r.range",
    "negative_distribution": PROB,
    "alias_table": PROB,
    "sgns_gradients": f"WITH {SPOTS} SELECT kind, i AS book_index, {rounded('sum(x)', 5)} AS g_sum, round(sqrt(sum(x * x)), 5) AS g_norm FROM g GROUP BY kind, i",
    "sgd_step": f"""WITH {SPOTS}, s AS (SELECT kind, i, sum(x) AS x FROM g GROUP BY ALL) SELECT m.i AS book_index, {rounded('list_sum(u) - 0.025 * coalesce(a.x, 0)', 5)} AS in_sum, {rounded('list_sum(v) - 0.025 * coalesce(b.x, 0)', 5)} AS out_sum
        FROM m LEFT JOIN s a ON a.kind = 'input' AND a.i = m.i LEFT JOIN s b ON b.kind = 'output' AND b.i = m.i""",
    "norm_stats": f"WITH {VEC} SELECT count(*) AS total, max(len(v)) AS dim, round(min(sqrt(list_inner_product(v, v))), 6) AS min_norm, round(avg(sqrt(list_inner_product(v, v))), 6) AS avg_norm, round(max(sqrt(list_inner_product(v, v))), 6) AS max_norm FROM vec",
    "normalize_vectors": f"WITH {UNIT} SELECT book_index, i, {rounded('x', 6)} AS x FROM (SELECT book_index, generate_subscripts(u, 1) - 1 AS i, unnest(u) AS x FROM unit)",
    "cosine_topk": f"WITH {UNIT} SELECT i.book_index, {rounded('list_inner_product(i.u, q.u)', 6)} AS similarity FROM unit i, unit q WHERE q.book_index = 7 AND i.book_index <> 7 ORDER BY similarity DESC, book_index LIMIT 5",
    "cosine_topk_batch": f"WITH {UNIT}, {NEAR.format(step=25)} SELECT query_id, book_index, similarity, rank FROM ranked",
    "vector_sum": f"WITH {VEC}, c AS (SELECT label, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM vec) SELECT CAST(label AS BIGINT) AS label, i, {rounded('sum(x)', 5)} AS x FROM c GROUP BY label, i",
    "vector_mean": f"WITH {VEC}, c AS (SELECT label, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM vec) SELECT CAST(label AS BIGINT) AS label, i, {rounded('avg(x)', 6)} AS x FROM c GROUP BY label, i",
    "similarity_report": f"WITH {UNIT}, {NEAR.format(step=50)}, meta AS (SELECT p_partkey - 1 AS id, p_name AS title FROM part WHERE p_size > 10) SELECT query_id, q.title AS query_title, rank, book_index, n.title AS title FROM ranked JOIN meta q ON q.id = query_id JOIN meta n ON n.id = book_index",
    "random_sample": "SELECT vec_id AS book_index FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 12",
    "resolve_title_exact": f"WITH {BOOKS} SELECT book_id, title FROM books WHERE lower(title) = lower({FIRST_TITLE}) ORDER BY length(title), book_id LIMIT 1",
    "resolve_title_partial": f"WITH {BOOKS} SELECT book_id, title FROM books WHERE contains(lower(title), lower(substr({FIRST_TITLE}, 2))) ORDER BY lower(title) <> lower(substr({FIRST_TITLE}, 2)), length(title), book_id LIMIT 1",
    "title_lookup": f"WITH {BOOKS} SELECT v.book_id, coalesce(title || ' (' || v.book_id || ')', v.book_id) AS label FROM (VALUES ('1'), ('5'), ('42'), ('10000000')) v(book_id) LEFT JOIN books USING (book_id)",
    "dedup_pairs": f"WITH {INTER} SELECT user_id, book_id, l_orderkey, l_linenumber, rating FROM inter QUALIFY row_number() OVER (PARTITION BY user_id, book_id ORDER BY {KEY}, is_read, rating) = 1",
    "holdout_split": f"WITH {SPLIT} SELECT user_id, book_id, is_holdout FROM sp",
    "random_sentences": f"WITH {POS} SELECT user_id, count(*) AS n_items, string_agg(book_id, ',' ORDER BY md5('42:' || user_id || ':' || book_id)) AS items FROM pos GROUP BY user_id HAVING count(*) >= 2",
    "ground_truth_sets": f"WITH {SPLIT} SELECT user_id, count(*) AS n_items, string_agg(book_id, ',' ORDER BY book_id) AS items FROM sp WHERE is_holdout GROUP BY user_id",
    "seen_sets": f"WITH {SPLIT} SELECT user_id, count(*) AS n_items, string_agg(book_id, ',' ORDER BY book_id) AS items FROM sp WHERE NOT is_holdout GROUP BY user_id",
    "user_profiles": f"WITH {PROFILE} SELECT user_id, i, {rounded('x', 6)} AS x FROM prof",
    "score_all": f"WITH {PROFILE} SELECT user_id, book_id, {SCORE} AS score FROM profile, bv",
    "unseen_topk": f"WITH {RECS} SELECT user_id, book_id, score, rank FROM recs",
    "recs_pretty": f"WITH {RECS}, {BOOKS} SELECT user_id, rank - 1 AS pos, book_id, title FROM recs LEFT JOIN books USING (book_id)",
    "precision_recall_at_10": f"WITH {EVAL} SELECT count(*) AS users, round(avg(hits / 10), 6) AS precision_at_10, round(avg(hits / greatest(1, n)), 6) AS recall_at_10 FROM ev",
    "hit_at_k": f"WITH {EVAL} SELECT count(*) AS users, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10 FROM ev",
    "ndcg_at_k": f"WITH {EVAL} SELECT count(*) AS users, round(avg(ndcg), 6) AS ndcg_at_10 FROM ev",
    "parse_read_at": f"WITH {EV} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS read_at FROM e",
    "min_history": f"WITH {EV} SELECT user_id, item_id, event_id FROM e QUALIFY count(*) OVER (PARTITION BY user_id) >= 8",
    "first_appearance_ids": f"WITH {EV} SELECT item_id, row_number() OVER (ORDER BY min(ROW(ts, event_id)), item_id) AS idx FROM e GROUP BY item_id",
    "time_sequences": f"WITH {SEQ} SELECT user_idx, len(ids) AS n_items, array_to_string(ids, ',') AS items FROM seq",
    "pad_truncate": f"WITH {SEQ}, l AS (SELECT user_idx, ids[-50:] AS s FROM seq), p AS (SELECT user_idx, {PAD.format('s')} AS ids FROM l) SELECT user_idx, len(ids) AS n_items, array_to_string(ids, ',') AS items FROM p",
    "shifted_targets": f"WITH {SEQ}, l AS (SELECT user_idx, ids[-50:] AS s FROM seq), t AS (SELECT user_idx, s[1:len(s) - 1] AS a, s[2:] AS b FROM l WHERE len(s) >= 2) SELECT user_idx, array_to_string({PAD.format('a')}, ',') AS inputs, array_to_string({PAD.format('b')}, ',') AS targets FROM t",
    "leave_one_out": f"WITH {EV}, r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id, CASE WHEN n < 3 THEN 'train' WHEN k = 1 THEN 'test' WHEN k = 2 THEN 'valid' ELSE 'train' END AS split FROM r",
}
