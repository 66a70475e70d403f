from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqrec.functions import arrays as A
from seqrec.operators import sequences as S
from seqrec.operators import vocab as V

SEQ = "user_id string, book_ids array<string>"
few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def arrays(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_consecutive_dedup_with_nulls(rows):
    df = rows([(["a", "a", "b", "b", "a"],), ([],), (["a", None, None, "b"],), ([None, "a"],), (None,)], "x array<string>")
    assert arrays(df, A.consecutive_dedup(F.col("x"))) == [["a", "b", "a"], [], ["a", None, "b"], [None, "a"], None]


def test_trim_and_pad(rows):
    df = rows([([1, 2, 3],), ([],), (list(range(51)),)], "x array<int>")
    assert arrays(df, A.trim_first(F.col("x"), 2)) == [[1, 2], [], [0, 1]]
    assert arrays(df, A.trim_last(F.col("x"), 2)) == [[2, 3], [], [49, 50]]
    assert arrays(df, A.left_pad(F.col("x"), 5))[:2] == [[0, 0, 1, 2, 3], [0] * 5]
    assert arrays(df, A.left_pad(F.col("x"), 50))[2] == list(range(1, 51))


def brute_pairs(seq, w):
    return Counter((seq[i], seq[j]) for i in range(len(seq)) for j in range(max(0, i - w), min(len(seq), i + w + 1)) if i != j)


@few
@given(seq=st.lists(st.integers(0, 4), max_size=14), w=st.integers(1, 6))
def test_pairs_match_brute_force_and_closed_form(spark, seq, w):
    df = spark.createDataFrame([("u", seq)], "user_id string, book_indices array<int>")
    want = brute_pairs(seq, w)
    for make in (V.training_pairs, V.training_pairs_selfjoin):
        assert Counter(tuple(r) for r in make(df, w).collect()) == want
    assert V.total_pairs(df, w).first()[0] == sum(want.values())
    assert all(want[a, b] == want[b, a] for a, b in want)


def test_pairs_of_null_and_short_sequences(rows):
    df = rows([("a", None), ("b", []), ("c", [1])], "user_id string, book_indices array<int>")
    assert V.training_pairs(df).count() == 0
    assert V.total_pairs(df).first()[0] == 0
    assert V.total_pairs(df.limit(0)).first()[0] == 0


def test_clean_sequences_counts_once_and_can_repeat_dedup(rows):
    data = [("u", b, 1, 5, i) for i, b in enumerate("axa")] + [("v", b, 1, 5, i) for i, b in enumerate("ab")] + [("w", "a", 1, 5, 0), ("z", "b", 0, 5, 0), ("z", "b", 1, 0, 1)]
    df = rows(data, "user_id string, book_id string, is_read int, rating int, t int")
    got = {r.user_id: r.book_ids for r in S.clean_sequences(df, ["t"], least_count=2).collect()}
    assert got == {"u": ["a", "a"]}
    assert S.clean_sequences(df, ["t"], least_count=2, redo_dedup=True).count() == 0


def test_vocabulary_is_lexicographic_and_dense(rows):
    df = rows([("u", ["10", "9", None]), ("v", ["2", "9"])], SEQ)
    assert {r.book_id: r.book_index for r in V.build_vocabulary(df).collect()} == {"10": 0, "2": 1, "9": 2}
    got = {r.user_id: r.book_indices for r in V.index_sequences(df, V.build_vocabulary(df).where("book_id <> '10'")).collect()}
    assert got == {"u": [2], "v": [1, 2]}


def test_row_index_is_global(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("k")).repartition(7)
    got = S.with_row_index(df, ["k"]).orderBy("k").collect()
    assert [r.row_index for r in got] == list(range(1000))


def test_holdout_covers_positives(rows):
    df = rows([("u", str(i)) for i in range(11)] + [("one", "x")], "user_id string, book_id string")
    got = S.holdout_split(df).collect()
    assert len(got) == 12
    assert sum(r.is_holdout for r in got if r.user_id == "u") == 3
    assert [r.is_holdout for r in got if r.user_id == "one"] == [True]


def test_k_core_matches_brute_force(rows):
    import random

    random.seed(3)
    pairs = sorted({(str(random.randint(0, 15)), str(random.randint(0, 15))) for _ in range(70)})
    want = set(pairs)
    while True:
        u, i = Counter(p[0] for p in want), Counter(p[1] for p in want)
        kept = {p for p in want if u[p[0]] >= 3 and i[p[1]] >= 3}
        if kept == want:
            break
        want = kept
    assert {tuple(r) for r in S.k_core(rows(pairs, "user_id string, item_id string"), 3).collect()} == want


def test_leave_one_out_and_min_history(rows):
    df = rows([("u", i) for i in range(4)] + [("v", 0), ("v", 1)], "user_id string, t int")
    got = {(r.user_id, r.t): r.split for r in S.leave_one_out(df, ["t"]).collect()}
    assert got == {("u", 0): "train", ("u", 1): "train", ("u", 2): "valid", ("u", 3): "test", ("v", 0): "train", ("v", 1): "train"}
    assert S.min_history(df, 3).select("user_id").distinct().collect()[0][0] == "u"


def test_dedup_keeps_first(rows):
    df = rows([("u", "a", 2), ("u", "a", 1), ("u", "b", 3)], "user_id string, book_id string, t int")
    assert sorted(tuple(r) for r in S.dedup_pairs(df, ["user_id", "book_id"], ["t"]).collect()) == [("u", "a", 1), ("u", "b", 3)]


def test_epoch_fractions():
    assert V.epoch_fractions(1000, 10, None) is None
    assert V.epoch_fractions(0, 10, 5) is None
    of_seq, of_pairs = V.epoch_fractions(10_000, 100, 1000)
    assert abs(of_seq - 0.15) < 1e-12 and abs(of_seq * of_pairs * 10_000 - 1000) < 1e-6
    assert V.epoch_fractions(10, 2, 1000) == (1.0, 1.0)
