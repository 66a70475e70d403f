"""Queries without a DuckDB twin, against brute force over the whole tables."""

from collections import Counter

from seqrec.operators import similarity as SIM
from seqrec.plans import catalogue as C
from seqrec.sources import synthetic as X

SF = "/root/testdata/sf0.001"


def test_k_core_is_that_of_all_interactions(spark):
    want = {(r.user_id, r.book_id) for r in X.interactions(spark, SF).select("user_id", "book_id").collect()}
    while True:
        users, items = Counter(u for u, _ in want), Counter(i for _, i in want)
        left = {(u, i) for u, i in want if users[u] >= 5 and items[i] >= 5}
        if left == want:
            break
        want = left
    got = [tuple(r) for r in C.k_core(spark, SF).select("user_id", "item_id").collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_lsh_recall_against_exact_search(spark):
    sf = "/root/testdata/sf0.01"
    v = X.item_vectors(spark, sf)
    asked = v.where("book_index % 50 = 0").select("book_index")
    want = {(r.query_id, r.book_index) for r in SIM.cosine_topk(v, asked, 5).collect()}
    got = {(r.query_id, r.book_index) for r in C.lsh_topk(spark, sf).collect()}
    assert len(got) == len(want) == 5 * asked.count() and len(got & want) >= 0.9 * len(want)


def test_lsh_gives_k_neighbours_however_far(spark):
    far = [[float(i == j) for j in range(8)] for i in range(8)] + [[-float(i == j) for j in range(8)] for i in range(8)]
    v = spark.createDataFrame(list(enumerate(far)), "book_index int, input_vector array<double>")
    out = SIM.lsh_topk(v, v.select("book_index"), 5)
    assert sorted(Counter(r.query_id for r in out.collect()).items()) == [(i, 5) for i in range(16)]
    assert set(out.columns) == {"query_id", "book_index", "similarity", "rank"} and SIM.lsh_topk(v, v.select("book_index").limit(0), 5).count() == 0
