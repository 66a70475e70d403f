"""Host-level quality rules (DataFrame operations only).

``base_signals`` measures every whole text; ``host_rates`` aggregates rule failures by host, shrinks each
host's rate towards a beta prior fitted to all other hosts and rejects the hosts whose rate is, with two
standard deviations to spare, beyond what that prior lets expect; ``host_quality`` joins the host verdicts
back to the documents.

Defined cases: a null text has no words and fails the length rule; a null host is a host of its own; a sole
host has no others to be held against and is kept; repeated rows each count; an empty table gives an empty
result; other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm.words import BLANKS, blank_words, text_or_empty
from seqrec.plans.lineage import BROADCAST_ROWS, materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host's limit is the other hosts' prior mean plus this many of its standard deviations, at least ``MATERIAL``
#: above the mean and at most half-way from the mean to failure of all documents.
PRIOR_SDS = 3.0
MATERIAL = 0.1
#: Standard deviations that a host's shrunk rate must be above the limit.
SURE_SDS = 2.0
#: Bounds of the prior's strength in documents.
WEAKEST, STRONGEST = 1.0, 100.0
#: Copies of a host row when the host table is too large to broadcast.
SALT = 32

#: Hash of the window that begins with word x at position i of ``_w``.
WINDOW_KEY = "xxhash64(x, get(_w, i + 1), get(_w, i + 2))"

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(docs: DataFrame) -> DataFrame:
    """``_hit``: where repeated 3-word windows begin, from ``_w`` (words).

    A packed window is a 64-bit hash whose low ``_k`` bits hold the window's position, so sorting brings equal
    windows together. ``_at`` names the places where neighbours share the hash. If some of those differ in their
    words, the hash has misled for this text and its windows are sorted by their words instead.
    """
    words = lambda a, b: " AND ".join(f"_w[{a} + {j}] = _w[{b} + {j}]" for j in range(3))
    spot = lambda i: f"int(_packed[{i}] & _mask)"
    window = f"slice(transform(_w, (x, i) -> shiftleft(shiftright({WINDOW_KEY}, _k), _k) | i), 1, _n - 2)"
    out = docs.withColumn("_packed", F.expr(f"CASE WHEN _n > 3 THEN sort_array({window}) ELSE array(0L) END"))
    out = out.withColumn("_at", F.expr("filter(sequence(0, size(_packed) - 1), i -> shiftright(_packed[i], _k) = shiftright(get(_packed, i + 1), _k))"))
    near = f"flatten(transform(_at, i -> array({spot('i')}, {spot('i + 1')})))"
    rows = "sort_array(transform(sequence(0, _n - 3), i -> struct(_w[i] AS a, _w[i + 1] AS b, _w[i + 2] AS c, i AS p)))"
    same = lambda y: " AND ".join(f"x.{c} = {y}.{c}" for c in "abc")
    exact = f"transform(flatten(transform(array({rows}), r -> filter(r, (x, i) -> coalesce({same('get(r, i + 1)')}, false) OR coalesce({same('get(r, i - 1)')}, false)))), x -> x.p)"
    misled = f"exists(_at, i -> NOT ({words(spot('i'), spot('i + 1'))}))"
    return out.withColumn("_hit", F.expr(f"CASE WHEN size(_at) = 0 THEN array() WHEN {misled} THEN sort_array({exact}) ELSE sort_array(array_distinct({near})) END"))


def base_signals(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus the five signals and ``base_failed`` for every row; one narrow pass."""
    text = text_or_empty(F.col(text_col))
    mine = [f"_keep{i}" for i in range(len(keep))]
    out = docs.select(*[F.col(c).alias(m) for c, m in zip(keep, mine, strict=True)], text.alias("_t"))
    out = out.select("*", blank_words(F.col("_t")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = out.select(
        *mine, "_w", F.size("_w").alias("_n"), F.expr("int(ceil(log2(size(_w) + 1)))").alias("_k"), lines.alias("_lines"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
    )
    out = out.select(*mine, "_w", "_n", "_k", F.expr("shiftleft(1L, _k) - 1").alias("_mask"), "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    covered = "aggregate(transform(_hit, (p, i) -> least(3, coalesce(get(_hit, i + 1) - p, 3))), 0L, (s, x) -> s + x)"
    out = _repeated(out).select(*[F.col(m).alias(c) for c, m in zip(keep, mine, strict=True)], F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(signals: DataFrame, host_col: str, material: float = MATERIAL) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, the limit it is held against and the verdict.

    The prior Beta(m s, (1 - m) s) of a host is fitted by moments to the rates of all other hosts, by taking its own
    share out of the sums: mean m, between-host variance v less the binomial share, strength s = m(1-m)/v - 1 within
    its bounds. So no host excuses itself. Partial aggregation makes a hot host cheap.
    """
    by_host = signals.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    total = by_host.agg(
        F.sum("host_docs").alias("_d"), F.sum("host_failed").alias("_f"), F.count(F.lit(1)).alias("_h"),
        F.sum(rate).alias("_r1"), F.sum(rate * rate).alias("_r2"), F.sum(F.lit(1.0) / F.col("host_docs")).alias("_inv"),
    )
    out = by_host.crossJoin(F.broadcast(total)).withColumn("_r", rate)  # the totals are one row
    out = out.withColumn("_m", F.expr("try_divide(_f - host_failed, _d - host_docs)"))
    between = F.expr("try_divide(_r2 - _r * _r, _h - 1) - 2 * _m * try_divide(_r1 - _r, _h - 1) + _m * _m - _m * (1 - _m) * try_divide(_inv - 1.0D / host_docs, _h - 1)")
    out = out.withColumn("_s", F.least(F.greatest(F.col("_m") * (1 - F.col("_m")) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(WEAKEST)), F.lit(STRONGEST)))
    m, s = F.coalesce("_m", "_r"), F.coalesce("_s", F.lit(WEAKEST))
    shrunk = (F.col("host_failed") + m * s) / (F.col("host_docs") + s)
    out = out.withColumn("host_rate", shrunk).withColumn("_sd", F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("host_docs") + s + 1)))
    limit = F.least(F.greatest(PRIOR_SDS * F.sqrt(m * (1 - m) / (s + 1)), F.lit(material)) + m, (1 + m) / 2)
    kept = F.col("_m").isNull() | (F.col("host_rate") - SURE_SDS * F.col("_sd") <= limit)
    return out.select("host", "host_docs", "host_failed", "host_rate", limit.alias("host_limit"), kept.alias("host_kept"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", material: float = MATERIAL, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Signals, host rate and ``kept`` for every document.

    Signals are measured once and written to the shared folder (a few numbers a row). The host table is
    broadcast if its counted rows allow; otherwise both sides are salted, so a host with a third of all
    documents is spread over many tasks.
    """
    signals = materialize(base_signals(docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("body")), ["id", "host"], "body"), "signals")
    hosts = materialize(host_rates(signals, "host", material), "hosts")
    if hosts.count() <= broadcast_rows:
        joined = signals.join(F.broadcast(hosts), signals["host"].eqNullSafe(hosts["host"]), "left").drop(hosts["host"])
    else:
        spread = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = signals.withColumn("_salt", F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALT)).cast("int"))
        joined = salted.join(spread, salted["host"].eqNullSafe(spread["host"]) & (salted["_salt"] == spread["_salt"]), "left").drop(spread["host"]).drop("_salt")
    kept = ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))
    return joined.select(F.col("id").alias(id_col), *SIGNALS, "base_failed", kept.alias("kept"), F.col("host").alias(host_col), "host_rate", "host_limit")
