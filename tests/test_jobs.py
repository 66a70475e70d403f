import json

import numpy as np

from seqrec import cli, jobs
from seqrec.operators import nextitem as NI
from seqrec.sources import writers as W


def test_preprocess_train_similar(spark, tmp_path):
    books = ["a", "b", "c", "d"]
    lines = ["user_id,book_id,is_read,rating,is_reviewed"] + [f"u{u},{b},1,{3 + u % 3},0" for u in range(15) for b in (books[u % 4 :] + books)[:4]] + ["u0,a,0,5,0", "u1,rare,1,5,0"]
    (tmp_path / "i.csv").write_text("\n".join(lines))
    data = {
        "books": [{"book_id": b, "title": f"Title {b}", "work_id": "w", "authors": [{"author_id": "1"}]} for b in [*books, "unread"]],
        "authors": [{"author_id": "1", "name": "N"}], "genres": [{"book_id": "a", "genres": {"g": 3}}], "works": [{"work_id": "w", "original_title": "O", "original_publication_year": "1999"}],
    }
    for k, v in data.items():
        (tmp_path / f"{k}.json").write_text("\n".join(map(json.dumps, v)))
    src = {"interactions": f"{tmp_path}/i.csv"} | {k: f"{tmp_path}/{k}.json" for k in data}
    got = jobs.preprocess(spark, src, f"{tmp_path}/out")
    assert got["user_count"] == 15 and got["vocabulary_size"] == 4
    seq = {r.user_id: r.book_ids for r in spark.read.parquet(f"{tmp_path}/out/user_sequences").collect()}
    assert seq["u1"] == ["b", "c", "d", "a"]
    report = W.read_json_artifact(spark, f"{tmp_path}/out/validation_report.json")
    assert report["metadata_coverage"]["coverage_pct"] == 100.0 and spark.read.parquet(f"{tmp_path}/out/book_metadata_lookup").count() == 4
    jobs.train(spark, f"{tmp_path}/out/user_sequences", f"{tmp_path}/model", dim=8, epochs=1)
    out = jobs.similar(spark, f"{tmp_path}/model", ["a", "nope"], ["title B"], 0, 2, f"{tmp_path}/out/book_metadata_lookup").collect()
    assert {r.query_id for r in out} == {"a", "b"} and len(out) == 4 and all(r.title.startswith("Title") and r.query_id != r.book_id for r in out)
    assert jobs.similar(spark, f"{tmp_path}/model", ["a"], k=1).count() == 1


def test_recommend_and_evaluate(spark):
    rows = [(str(u), f"b{(u * 7 + i) % 12}", "4") for u in range(20) for i in range(6)] + [(None, "b1", "5"), ("1", "b2", "x")]
    df = spark.createDataFrame(rows, "user_id string, book_id string, rating string")
    for fit_on in ("all", "train"):
        recs, m = jobs.recommend_and_evaluate(df, 3, fit_on, dim=4, min_count=1, iterations=1)
        assert m.first().users == 20 and 0 <= m.first().ndcg <= 1
        assert recs.groupBy("user_id").count().where("count <= 3").count() == 20


def test_next_item_dataset_and_weights(spark, tmp_path):
    t = "Sun Jul {:02d} 07:44:10 -0700 2017"
    (tmp_path / "r.json").write_text("\n".join(json.dumps({"user_id": "u", "book_id": str(i), "read_at": t.format(i + 1), "date_added": ""}) for i in range(6)))
    jobs.prepare_next_item(spark, f"{tmp_path}/r.json", f"{tmp_path}/d")
    seq, users, items = NI.load_dataset(spark, f"{tmp_path}/d")
    assert seq.first()["items"] == [1, 2, 3, 4, 5, 6] and users.count() == 1
    w = NI.init_weights(6, hidden=4, length=5)
    NI.save_weights(spark, w, f"{tmp_path}/w")
    back = NI.load_weights(spark, f"{tmp_path}/w")
    assert set(back) == set(w) and all(np.array_equal(back[k], w[k]) for k in w)
    got = NI.next_for_ids(spark, ["0", "unknown", "2"], items, back, 9, 5).orderBy("rank").collect()
    assert {r.item_id for r in got} == {"1", "3", "4", "5"}
    assert NI.next_for_ids(spark, ["unknown"], items, back).count() == 0


def test_command_line():
    a = cli.parser().parse_args(["similar", "--model-dir", "m", "--book-ids", "1,2", "--title", "x", "--top-k", "3"])
    assert (a.job, a.top_k, a.title) == ("similar", 3, ["x"])
