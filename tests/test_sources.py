import json

import pytest
from pyspark.sql import functions as F

from seqrec.functions import text_time as T
from seqrec.operators import metadata as M
from seqrec.operators import nextitem as NI
from seqrec.operators import report as RP
from seqrec.sources import readers as R
from seqrec.sources import writers as W
from seqrec.streaming import ingest as ST


def test_csv_and_parquet_interactions(spark, tmp_path):
    (tmp_path / "i.csv").write_text("user_id,book_id,is_read,rating,is_reviewed\n1,2,1,5,0\n1,3,0,4,0\n")
    df = R.read_interactions_csv(spark, str(tmp_path / "i.csv"))
    assert df.dtypes[2:4] == [("is_read", "int"), ("rating", "int")] and df.count() == 2
    raw = spark.createDataFrame([("u", "1", "2.9"), ("u", None, "3"), ("v", "2", ""), (None, "2", "4")], "user_id string, book_id string, rating string")
    W.write_parquet(raw, str(tmp_path / "p"))
    assert [tuple(r) for r in R.read_interactions_parquet(spark, str(tmp_path / "p")).collect()] == [("u", "1", 2.9)]


def test_json_kinds_and_metadata_assembly(spark, tmp_path):
    books = [
        {"book_id": "1", "title": "Alpha", "title_without_series": "Alpha", "average_rating": "4.5", "ratings_count": "", "publication_year": "19x", "work_id": "w", "series": ["s"], "authors": [{"author_id": "a"}, {"author_id": "zz"}]},
        {"book_id": "2", "title": None, "average_rating": "", "ratings_count": "7", "publication_year": "2001", "work_id": None, "series": [], "authors": []},
    ]
    genres = [{"book_id": "1", "genres": {"b, c": 2, "a": 2, "d": 9, "e": 1, "f": 1, "g": 1}}, {"book_id": "2", "genres": {}}]
    for name, data in {"books": books, "genres": genres, "authors": [{"author_id": "a", "name": "Ann"}], "works": [{"work_id": "w", "original_title": "A", "original_publication_year": "1990"}, {"work_id": "x"}]}.items():
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, data)))
    read = lambda k: R.read_json_lines(spark, str(tmp_path / f"{k}.json"), k)
    typed = M.typed_books(read("books"))
    links = M.author_links(typed)
    assert {tuple(r) for r in links.collect()} == {("1", "a"), ("1", "zz"), ("2", None)}
    names = M.author_names(links, read("authors").withColumnRenamed("name", "author_name"))
    works = M.referenced_works(read("works"), typed)
    assert works.count() == 1
    out = {r.book_id: r for r in M.metadata_lookup(typed, names, M.top_genres(read("genres")), works).collect()}
    assert list(out["1"].asDict()) == M.COLUMNS
    assert out["1"].author_names == ["Ann"] and out["1"].top_genres == ["d", "a", "b, c", "e", "f"]
    assert out["1"].ratings_count is None and out["1"].publication_year is None and out["1"].work_original_publication_year == 1990
    assert out["2"].top_genres is None and out["2"].author_names == [] and out["2"].average_rating is None


def test_titles(rows):
    meta = rows([("1", "The Night"), ("2", "Night"), ("3", "nightfall"), ("4", None), ("5", "100% night_x")], "book_id string, title string")
    got = {r.query: (r.book_id, r.title) for r in M.resolve_titles(meta, ["NIGHT", "  ", "fall", "0% n", "absent"]).collect()}
    assert got == {"NIGHT": ("2", "Night"), "fall": ("3", "nightfall"), "0% n": ("5", "100% night_x")}
    assert {tuple(r) for r in M.titles_of(meta, ["1", None, "1", "9"]).collect()} == {("1", "The Night")}
    ids = rows([("2",), ("77",)], "book_id string")
    assert {r.label for r in M.with_labels(ids, meta).collect()} == {"Night (2)", "77"}


def test_read_time(rows):
    df = rows([("Sun Jul 30 07:44:10 -0700 2017", None), ("", "Mon Jan 02 00:00:01 +0000 2006"), ("bad", "Mon Jan 02 00:00:01 +0000 2006"), (None, None), ("Sun Xxx 30 07:44:10 -0700 2017", "")], "read_at string, date_added string")
    got = [str(r[0]) for r in df.select(T.read_time(F.col("read_at"), F.col("date_added"))).collect()]
    assert got == ["2017-07-30 07:44:10", "2006-01-02 00:00:01", "None", "None", "None"]


def test_review_preparation(spark, rows):
    t = "Sun Jul {:02d} 07:44:10 -0700 2017"
    data = [("u", str(i), t.format(20 - i), "") for i in range(5)] + [("u", "0", t.format(25), ""), ("v", "1", t.format(1), ""), ("u", "9", "", "")]
    seq, users, items = NI.time_sequences(NI.timed_reviews(rows(data, R.REVIEWS)), ["ts"], 5)
    assert [r.asDict() for r in seq.collect()] == [{"user_idx": 1, "items": [1, 2, 3, 4, 5]}]
    assert {r.item_id: r.item_idx for r in items.collect()} == {"4": 1, "3": 2, "2": 3, "1": 4, "0": 5}


def test_artifacts_models_and_lookup(spark, tmp_path, rows):
    W.write_json_artifact(spark, f"{tmp_path}/a/manifest.json", {"x": 1})
    assert R.exists(spark, f"{tmp_path}/a/manifest.json") and W.read_json_artifact(spark, f"{tmp_path}/a/manifest.json") == {"x": 1}
    seq = rows([("u", ["a", "b"]), ("u", ["a"])], "user_id string, book_ids array<string>")
    meta = rows([("a", "A")], "book_id string, title string")
    report = RP.validation_report(seq, meta)
    W.write_json_artifact(spark, f"{tmp_path}/report.json", report)
    got = W.read_json_artifact(spark, f"{tmp_path}/report.json")
    assert got["duplicate_users"] == 1 and got["short_sequences"] == 1 and got["metadata_coverage"] == {"vocabulary_size": 2, "covered": 1, "missing": 1, "coverage_pct": 50.0}
    assert RP.coverage(seq.limit(0), meta).first()["coverage_pct"] == 0.0
    assert RP.length_stats(seq.limit(0)).first().asDict() == {"tokens": 0, "avg_length": 0.0, "median_length": 0, "max_length": 0}
    m = RP.manifest(seq, {}, {})
    assert m["user_count"] == 2 and m["vocabulary_size"] == 2
    W.save_model(rows([(0, [1.0], [2.0])], "book_index int, input_vector array<float>, output_vector array<float>"), rows([("a", 0)], "book_id string, book_index int"), f"{tmp_path}/m/")
    assert R.load_model(spark, f"{tmp_path}/m")[2].first().asDict() == {"book_index": 0, "book_id": "a", "input_vector": [1.0]}
    assert R.load_metadata_lookup(spark, None) is None and R.load_metadata_lookup(spark, f"{tmp_path}/none") is None
    assert R.parse_id_list(" 1, 2,,3 ") == ["1", "2", "3"] and R.parse_title_lines("a\n\n b ") == ["a", "b"]


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"user_id": "u", "book_id": str(i), "is_read": i % 2, "rating": 3, "ts": f"2024-01-0{i + 1}T00:00:00"}) for i in range(4)))
    q = ST.ingest(ST.read_stream(spark, str(src)), f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    q.awaitTermination(60)
    assert {r.book_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"1", "3"}
    assert ST.item_counts(ST.read_stream(spark, str(src))).isStreaming


def test_training_needs_torch(rows):
    try:
        import torch  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            NI.train(None, 3)
