"""Shuffle paths beyond the broadcast limits give the same results as the broadcast ones."""

import random

import pytest

from llm_util import DOCS
from seqrec.llm import components as C
from seqrec.llm import line_dedup as LD
from seqrec.llm import near_dedup as ND
from seqrec.llm import url_filter as UF


@pytest.fixture
def no_broadcast(monkeypatch):
    for module in (C, LD, ND, UF):
        monkeypatch.setattr(module, "small_side", lambda df, limit=0, rows=None: df)


def documents(spark):
    rng = random.Random(12)
    lines = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 30))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 5))), "en", "a", 1) for i in range(60)]
    return spark.createDataFrame(rows, DOCS)


def key(df):
    return sorted(map(repr, df.collect()))


def test_without_broadcast(spark, request):
    docs = documents(spark)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.net/{'ab'[i % 2]}/{i}") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(40)], "id long, bad boolean")
    run = lambda: (key(ND.near_duplicates(docs, k=3, percent=60)), key(LD.dedup_lines(docs)), key(UF.filter_urls(pages, labels, [])))
    want = run()
    request.getfixturevalue("no_broadcast")
    assert run() == want


def test_line_dedup_beyond_every_limit(spark, monkeypatch):
    """Nothing fits a broadcast: the same lines go, and of its own tables only the list of them stays in the shared folder."""
    from seqrec.plans import lineage

    docs = documents(spark)
    want = key(LD.dedup_lines(docs))
    monkeypatch.setattr(lineage, "BROADCAST_BYTES", 0)
    before = {path for _, path in lineage._made}
    assert key(LD.dedup_lines(docs)) == want
    left = [path.rsplit("/", 1)[1] for _, path in lineage._made if path not in before]
    assert sorted({x.rsplit("-", 1)[0] for x in left}) == ["gone-lines", "links"]
