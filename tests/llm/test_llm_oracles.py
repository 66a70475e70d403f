import hashlib

import pytest
from pyspark.sql import functions as F

from llm_util import DOCS, awkward, blank_words, letter_words
from oracle import compare, plain
from seqrec.llm import decontaminate as DC
from seqrec.llm import queries as Q
from seqrec.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, name):
    compare(spark, Q.QUERIES[name], ORACLES[name], SF)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with awkward tables."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = [r for r in awkward() if r[0] is not None]
    docs = [r for i, r in enumerate(docs) if r[0] not in {x[0] for x in docs[:i]}]  # the SQL twins need unique ids
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    bench = [(1, docs[0][1]), (2, "two words"), (3, None), (4, ""), (5, "one"), (None, "x9 x9"), (6, docs[0][1]), (6, docs[0][1]), (7, "Tail -- x"), (8, docs[7][1][:400])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    chats = [(1, 0, "user", "a ### b"), (1, 1, "assistant", "</turn>\n### @user: x \\\\ \\"), (1, 1, "assistant", "tie"), (2, None, None, None), (3, 0, "to:ol\\ ### ", "####</turn></turn>"), (3, 1, "assistant", ""), (3, 2, "assistant", None), (4, 5, "system", "s"), (4, 6, "user", "é漢"), (4, 7, "assistant", "😀 ok"), (None, 0, "user", "n")]
    spark.createDataFrame(chats, CHAT).write.parquet(f"{folder}/conversations.parquet")
    return folder


def duck(folder, sql):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_source_mix", "op10_host_rules"])
def test_awkward_tables_same_as_duckdb(spark, odd, name):
    got, want = Q.QUERIES[name](spark, odd).toPandas(), duck(odd, ORACLES[name])
    assert plain(got) == plain(want)


def test_chat_round_trip(spark, odd):
    got = {r.conv_id: r for r in Q.op3_chat_format(spark, odd).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{odd}/conversations.parquet").collect()] + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        turns = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest(), conv
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-7].valid and got[4].valid and not got[2].valid and not got[1].valid and not got[3].valid


def windows(item):
    w = letter_words(item)
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def test_decontamination_matches_brute_force_in_any_blocks(spark, odd):
    docs, bench = spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/benchmark.parquet")
    items = [("null" if r.item_id is None else str(r.item_id), windows(r.text)) for r in bench.collect()]
    want = {}
    for r in docs.collect():
        w, hit, found = letter_words(r.text), set(), set()
        for name, wins in items:
            for win in wins:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(name)
        want[r.doc_id] = (len(w), len(hit), sorted(found))
    for block in (10**6, 7):
        got = {r.doc_id: (r.n_words, sum(s.last - s.first + 1 for s in r.spans), r["items"]) for r in DC.find_contamination(docs, bench, block=block).collect()}
        assert got == want
        clean = {r.doc_id for r in DC.drop_contaminated(docs, bench, block=block).collect()}
        assert clean == {i for i, v in want.items() if not v[1]}
    assert DC.find_contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert DC.drop_contaminated(docs.limit(0), bench).count() == 0
    assert any(v[2] for v in want.values())


def test_mix_takes_what_the_plan_says(spark, odd):
    from seqrec.llm.mixing import mix, plan_mix

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    plan = {r.id: r for r in plan_mix(docs).collect()}
    copies = {r.doc_id: r.n for r in mix(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert copies == {i: r.n_copies for i, r in plan.items() if r.n_copies}
    assert all(r.size == len(blank_words(d.text)) and r.taken <= 2 * r.size for d in docs.collect() for r in [plan[d.doc_id]])
    total = sum(r.size for r in plan.values())
    targets = {r.source: (r.target, r.source_size) for r in plan.values()}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * s + 1e-6 for t, s in targets.values())
    salted = {r.id: r.taken for r in plan_mix(docs, broadcast_rows=0).collect()}
    assert salted == {i: r.taken for i, r in plan.items()}


def test_hosts_salted_alike(spark, odd):
    from seqrec.llm.quality_rules import host_quality

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(host_quality(docs, broadcast_rows=0)) == key(host_quality(docs))


def test_bad_host_is_dropped(spark):
    from seqrec.llm.quality_rules import host_quality

    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "en", "junk", 1) for i in range(95)] + [(95 + i, good, "en", "junk", 1) for i in range(5)] + [(200 + i, good, "en", f"h{i % 9}", 1) for i in range(90)]
    kept = {r.doc_id for r in host_quality(spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert kept == set(range(200, 290))


def test_windows_that_share_a_hash_are_told_apart(spark, odd, monkeypatch):
    from seqrec.llm import quality_rules as QR

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    want = sorted((r.doc_id, r.n_repeat_words) for r in QR.base_signals(docs, ["doc_id"]).collect())
    monkeypatch.setattr(QR, "WINDOW_KEY", "shiftleft(pmod(xxhash64(x, get(_w, i + 1), get(_w, i + 2)), 5L), 58)")
    assert sorted((r.doc_id, r.n_repeat_words) for r in QR.base_signals(docs, ["doc_id"]).collect()) == want
    assert any(n for _, n in want)


def test_host_verdict_same_as_duckdb_where_hosts_differ(spark, tmp_path):
    """Two bad hosts among 30, one sole failing document, a hot clean host; the bad ones are rejected in both engines."""
    good = " ".join(f"w{i}" for i in range(60))
    rows, at = [], 0
    for h in range(30):
        n, bad = (400, 0.05) if h == 3 else (40 + h, 0.9 if h in (7, 11) else 0.1)
        for i in range(n):
            rows.append((at, "short" if i < bad * n else good, "en", f"h{h}" if h else None, 1))
            at += 1
    rows.append((at, "alone", "en", "single", 1))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Q.op10_host_rules(spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(con.execute(ORACLES["op10_host_rules"]).df())
    source = {r[0]: r[3] for r in rows}
    refused = {source[r.doc_id] for r in got.itertuples() if not r.base_failed and not r.kept}
    assert refused == {"h7", "h11"}
