import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_util import DOCS, awkward, with_clashes
from seqrec.llm import decontaminate as DC
from seqrec.llm import kernels as K
from seqrec.llm import language_id as LI
from seqrec.llm import license_scan as LS
from seqrec.llm import line_dedup as LD
from seqrec.llm import near_dedup as ND
from seqrec.llm import quality_pu as QP
from seqrec.llm import queries as Q
from seqrec.llm import url_filter as UF
from seqrec.llm.chat import chat_digest, format_chats
from seqrec.llm.folds import held_out
from seqrec.llm.mixing import mix, plan_mix
from seqrec.llm.quality_rules import host_quality

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_fold_rule(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_quality_held_out(spark):
    got = Q.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    assert len(got) > 50 and right >= 0.93
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_never_sees_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = QP.fit(docs, labels), QP.fit(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), flipped)
    assert np.array_equal(a.weight, b.weight)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    none = spark.createDataFrame([], LABELS)
    assert QP.fit(docs, none) == 0.5
    out = QP.score_quality(docs, 0.5).collect()
    assert len(out) == len(awkward()) and {r.predicted for r in out} == {1}


def test_nnpu_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (400, 3)), rng.normal(-2, 1, (100, 3))
    m = QP.fit_nnpu(good[:200], np.vstack([good[200:], bad[:50]]), 0.8)
    assert (m.score(good) > 0.5).mean() > 0.95 and (m.score(bad) < 0.5).mean() > 0.9


def test_language_held_out_and_rejection(spark):
    got = Q.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert np.mean([r.rejected for r in got]) < 0.005 and all(0 <= r.score <= 1 for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = LI.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "Привет мир, это совсем другой язык и другая письменность " * 9), (5, docs.first().text)], "doc_id long, text string")
    out = {r.doc_id: r for r in LI.identify(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [out[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert out[4].rejected and not out[5].rejected and out[4].lang_pred in model.langs
    assert {r.doc_id for r in LI.keep_known(odd, model).collect()} == {5}


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 1)], DOCS)
    assert LI.fit(docs) is None
    assert LI.identify(docs, None).first().lang_pred == "und" and LI.keep_known(docs, None).count() == 0


def test_trigrams_ignore_case_and_breaks():
    buf, off, _ = K.strings(pa.array(["Ébène, THE", "ébène the", "", "x"]))
    c = LI.trigram_counts(buf, off)
    assert np.array_equal(c[0], c[1]) and c[2].sum() == 0 and c[3].sum() == 1


def url_cases():
    import re

    rules = [UF.Rule("allow", "org", "/"), UF.Rule("block", "example.org", "/es/"), UF.Rule("block", "com", "/de/")]
    urls = ["http://EXAMPLE.org/es/1?x=/en/", "https://a.example.org/en", "http://xexample.org/es/", "http://com/de/", "http://a.com/de", "no scheme", None, "http://h", "x://y://z/a", "http://u:p@Ex.org:8/#/es/", "://org/", "http://bé.ORG/é?#"]
    want = []
    for u in urls:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        want.append((host, path, best and best.text, best and best.verdict))
    return urls, rules, want


def test_url_verdicts(spark):
    urls, rules, want = url_cases()
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "id long, bad boolean")
    got = {r.page_id: r for r in UF.filter_urls(pages, none, rules).collect()}
    for i, (host, path, rule, verdict) in enumerate(want):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")


def test_bad_template_is_rejected_and_others_stay(spark):
    rows = [(i, f"http://h.net/{('spam', 'news', 'blog')[i % 3]}/{i}.html") for i in range(300)] + [(1000 + i, f"http://h.net/spam/x{i}y") for i in range(5)] + [(2000 + i, f"http://q.net/{'ab'[i % 2] * (i + 1)}") for i in range(60)]
    labels = [(i, i % 3 == 0) for i in range(300)]
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad boolean")
    got = {r.page_id: r for r in UF.filter_urls(pages, marks, []).collect()}
    assert all((got[i].verdict == "block") == (i % 3 == 0) for i in range(300))
    assert got[0].template == "/spam/*.html" or got[0].template.startswith("/spam/")
    assert {got[2000 + i].template for i in range(60)} == {"/*"} and got[2000].verdict == "allow"
    assert UF.filter_urls(pages.limit(0), marks, []).count() == 0


def test_license_scan_finds_templates_inside_noise(spark):
    long = LS.NOTICES["MIT"][2]
    noise = " ".join(f"n{i}" for i in range(500))
    near = long.split()
    near[20] = "changed"
    docs = spark.createDataFrame([(1, noise + " " + long + " " + noise), (2, noise), (3, None), (4, ""), (5, " ".join(near)), (6, "released UNDER, the mit-license"), (7, "the MIT License")], "doc_id long, text string")
    got = {r.doc_id: {m.license for m in r.matches} for r in LS.scan_licenses(docs).collect()}
    assert got == {1: {"MIT"}, 2: set(), 3: set(), 4: set(), 5: {"MIT"}, 6: {"MIT"}, 7: set()}
    assert LS.scan_licenses(docs.limit(0)).count() == 0


CASES = {
    "license": lambda d, b, t: LS.scan_licenses(d),
    "plan_mix": lambda d, b, t: plan_mix(d),
    "mix": lambda d, b, t: mix(d),
    "quality": lambda d, b, t: QP.score_quality(d, QP.fit(d, t)),
    "identify": lambda d, b, t: LI.identify(d, LI.fit(d)),
    "keep_known": lambda d, b, t: LI.keep_known(d, LI.fit(d)),
    "find_contamination": lambda d, b, t: DC.find_contamination(d, b),
    "drop_contaminated": lambda d, b, t: DC.drop_contaminated(d, b),
    "dedup_lines": lambda d, b, t: LD.dedup_lines(d),
    "near": lambda d, b, t: ND.near_duplicates(d, k=3, percent=85),
    "drop_near": lambda d, b, t: ND.drop_near_duplicates(d),
    "hosts": lambda d, b, t: host_quality(d),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_awkward_rows_clashing_columns_and_empty_tables(spark, case):
    docs = spark.createDataFrame(awkward(), DOCS)
    bench = spark.createDataFrame([(1, "étre ing"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(awkward())] + [(0, None, None), (None, 1, 1)], LABELS)
    plain = CASES[case](docs, bench, labels)
    odd = CASES[case](with_clashes(docs), with_clashes(bench), labels)
    cols = [c for c in plain.columns if c in odd.columns]
    key = lambda df: sorted((tuple(map(str, r)) for r in df.select(*cols).collect()))
    rows = key(plain)
    assert rows
    if case in ("keep_known", "drop_contaminated", "dedup_lines", "drop_near", "mix"):  # whole rows: extra columns are carried
        assert odd.columns == with_clashes(docs).columns
    assert key(odd) == rows
    assert CASES[case](docs.limit(0), bench, labels).count() == 0


def test_chat_clashes(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "y")], "conv_id long, turn long, role string, text string, segments string")
    assert chat_digest(format_chats(turns)).first().n_turns == 2
    assert chat_digest(format_chats(turns.limit(0))).count() == 0


def random_text(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "thing", "ered", "onst"]) + str(rng.randint(0, 9)) for _ in range(n))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(2)
    item = random_text(rng, 30)
    base = [random_text(rng, 120) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s0", 1), (101, base[1] + " more", "en", "s0", 1), (102, base[2] + "\n" + random_text(rng, 9), "en", "s0", 1), (103, random_text(rng, 50) + " " + item + " " + random_text(rng, 50), "en", "s1", 1), (104, None, "en", "s1", 0), (105, "12 34", "en", "s1", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert kept["language_id"] >= set(range(40)) | {100, 101, 102, 103} and not kept["language_id"] & {104, 105}
    assert 100 not in kept["line_dedup"] and kept["line_dedup"] >= set(range(40))
    assert not kept["near_dedup"] & {100} and kept["near_dedup"] >= set(range(40))
    assert kept["decontaminate"] == kept["near_dedup"] - {103}
    assert kept["mix"] <= kept["decontaminate"]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == kept["mix"]


def test_bad_section_of_a_wide_or_deep_host_is_rejected(spark):
    names = ["".join("abcdefghij"[int(c)] for c in str(k)) for k in range(100, 130)]
    rows = [(k * 100 + i, f"http://w.net/{n}/{i}.html") for k, n in enumerate(names) for i in range(100)]
    rows += [(10_000 + i, f"http://d.net/a/b/c/d/e/f/{('good', 'spam')[i % 2]}/{i}.html") for i in range(200)]
    bad = lambda i: i < 100 or (i >= 10_000 and i % 2 == 1)
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, bad(i)) for i, _ in rows], "id long, bad boolean")
    got = {r.page_id: r for r in UF.filter_urls(pages, marks, []).collect()}
    assert all((got[i].verdict == "block") == bad(i) for i, _ in rows)
    assert got[0].template == f"/{names[0]}/*.html" and got[100].template == "/*/*.html"


def brute_urls(pages, bad_of, rules):
    """page_id -> verdict by plain loops: rules, then templates level by level, purity and its upper end."""
    import math

    def parts(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    def shaped(path):
        return tuple(re.sub(r"^.*?(\.[A-Za-z]{1,5})?$", lambda m: "*" + (m[1] or ""), x, count=1) if re.search("[0-9]", x) else x for x in path.split("/") if x)

    rows = {}  # (host, shape) -> [labelled, bad]
    for i, u in pages:
        host, path = parts(u)
        cell = rows.setdefault((host, shaped(path)), [0, 0])
        if i in bad_of:
            cell[0] += 1
            cell[1] += bad_of[i]
    template = dict.fromkeys(rows, "")
    for d in range(max(len(k[1]) for k in rows)):
        kids = {}
        for k, (n, b) in rows.items():
            if len(k[1]) > d:
                cell = kids.setdefault((k[0], template[k]), {}).setdefault(k[1][d], [0, 0])
                cell[0], cell[1] = cell[0] + n, cell[1] + b
        names = {}
        for node, own in kids.items():
            ls, bs = sum(v[0] for v in own.values()), sum(v[1] for v in own.values())
            pool = (bs + 1) / (ls + 2)
            for seg, (n, b) in own.items():
                alike = n == 0 or abs(b / n - pool) / math.sqrt(pool * (1 - pool) * (1 / n + 1 / (ls + 2))) < UF.SIMILAR_Z
                wide = len(own) > UF.MAX_KIDS
                names[node, seg] = "*" if wide and (alike or n < UF.RARE) else "+" if not wide and len(own) > 1 and alike else seg
        template = {k: t + "/" + names[(k[0], t), k[1][d]] if len(k[1]) > d else t for k, t in template.items()}
    host_l, leaf = {}, {}
    for k, (n, b) in rows.items():
        for table, key in ((host_l, k[0]), (leaf, (k[0], template[k]))):
            cell = table.setdefault(key, [0, 0])
            cell[0], cell[1] = cell[0] + n, cell[1] + b
    tl, tb = (sum(v[j] for v in host_l.values()) for j in (0, 1))
    base = (tl - tb + UF.PRIOR_GOOD) / (tl + UF.PRIOR_GOOD + UF.PRIOR_BAD)
    out = {}
    for i, u in pages:
        host, path = parts(u)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            out[i] = max(fits, key=lambda r: len(r.text)).verdict
            continue
        n, b = leaf[host, template[host, shaped(path)]]
        hn, hb = host_l[host]
        p = (n - b + UF.STRENGTH * (hn - hb + UF.STRENGTH * base) / (hn + UF.STRENGTH)) / (n + UF.STRENGTH)
        out[i] = "block" if p + UF.SURE * math.sqrt(p * (1 - p) / (n + UF.STRENGTH + 1)) < UF.MIN_PURITY else "allow"
    return out


def test_url_templates_match_brute_force(spark):
    """Hosts with a bad section, with many sections, with deep paths; a seed word; rules."""
    rng = random.Random(8)
    rules = [UF.Rule("allow", "org", "/"), UF.Rule("block", "bad.org", "/x/"), UF.Rule("block", "com", "/de/")]
    pages, marks = [], []
    for i in range(2500):
        host = rng.choice(["a.net", "A.net", "wide.net", "deep.net", "my-casino.net", "w.bad.org", "c.com", ""])
        seg = rng.choice(["shop", "news", "de", "x"]) if host != "wide.net" else f"s{chr(97 + rng.randrange(26))}"
        path = f"/{seg}/" + ("/".join("pqr"[rng.randrange(3)] for _ in range(8)) if host == "deep.net" else f"{i}.html")
        pages.append((i, f"http://{host}{path}?q=1" if host else rng.choice([None, "no url"])))
        if rng.random() < 0.6:
            worse = (seg in ("shop", "sd")) + (host == "deep.net" and path.endswith("/r"))
            marks.append((i, rng.random() < (0.95 if worse else 0.05)))
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(marks, "id long, bad boolean").unionByName(UF.url_labels(df, rules))
    bad_of = {}
    for r in labels.collect():
        bad_of[r.id] = max(bad_of.get(r.id, 0), int(r.bad))
    got = {r.page_id: (r.verdict, r.rule) for r in UF.filter_urls(df, labels, rules).collect()}
    assert {i: v for i, (v, _) in got.items()} == brute_urls(pages, bad_of, rules)
    free = [v for v, rule in got.values() if rule is None]
    assert free.count("block") > 50 and free.count("allow") > 50
