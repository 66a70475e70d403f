"""Quality classification by positive-unlabelled learning.

A logistic model over byte-class bigrams and repetition measures is fitted by minimising the
non-negative unbiased risk  pi * E+[l(g)] + max(0, E_u[l(-g)] - pi * E+[l(-g)])  with logistic loss l:
trusted positives are texts labelled 1, the unlabelled are texts without a label, and the class prior
pi is estimated as the smoothed share of label 1 among the labelled rows. No text labelled 0 is shown
to the model.

The fit uses at most about ``POSITIVES`` and ``UNLABELLED`` texts, drawn by id hash (the documented bound);
features are computed on the executors and only their numbers reach the driver.

Defined cases: a null text scores as an empty one; conflicting labels of an id count as 0; repeated rows
are each scored; with no positives to learn from every score is the prior (0.5 without labels); other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import kernels as K
from seqrec.llm.folds import draw, learnable
from seqrec.plans.lineage import small_side
from seqrec.plans.session import bounded_batches

POSITIVES, UNLABELLED = 4000, 8000
STEPS, RATE, DECAY = 600, 0.05, 1e-4
CUT = 0.3

#: Byte classes: other, lower, upper, digit, blank, line feed, stop, comma, mark, dash, bracket, quote, bar, symbol, slash, non-ASCII.
_GROUPS = ["", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",;:", "!?", "-_", "()[]{}", "'\"`", "|", "#*$%&<>@=+~^", "/\\"]
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 15
_TEXTS = 1024
N_FEATURES = 256 + 7


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES): root shares of class bigrams; log words, distinct words, top word, repeats next to each other, word length, repeated lines, log bytes a line."""
    n, size = len(off) - 1, np.diff(off)
    kind = _CLASS[buf[off[0] : off[-1]]]
    out = np.zeros((n, N_FEATURES), np.float32)
    if len(kind) > 1:
        owner = np.repeat(np.arange(n), size)
        inside = owner[1:] == owner[:-1]
        pair = (owner[:-1] * 256 + kind[:-1] * 16 + kind[1:])[inside]
        count = np.bincount(pair, minlength=n * 256).reshape(n, 256)
        out[:, :256] = np.sqrt(count / np.maximum(size - 1, 1)[:, None])
    w = K.hash_words(buf, off, K.BLANK_TABLE)
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    order = np.lexsort((w.hash, w.owner))
    h, o = w.hash[order], w.owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    spot = np.flatnonzero(new)
    times = np.diff(np.append(spot, len(h)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[spot], times)
    twin = np.zeros(len(w.hash), bool)
    twin[1:] = (w.hash[1:] == w.hash[:-1]) & (w.owner[1:] == w.owner[:-1])
    lines, repeated = line_repeats(buf, off)
    out[:, 256] = np.log1p(words) / 5
    out[:, 257] = np.bincount(o[spot], minlength=n) / some
    out[:, 258] = top / some
    out[:, 259] = np.bincount(w.owner[twin], minlength=n) / some
    out[:, 260] = np.log1p(np.bincount(w.owner, weights=w.end - w.start, minlength=n) / some)
    out[:, 261] = repeated / np.maximum(lines, 1)
    out[:, 262] = np.log1p(size / np.maximum(lines, 1)) / 5
    return out


_LINE_TABLE = K.byte_table(lambda b: b != 10, lower=False)


def line_repeats(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(non-empty lines, lines equal to an earlier one) of each text."""
    n = len(off) - 1
    x = K.hash_words(buf, off, _LINE_TABLE)
    order = np.lexsort((x.hash, x.owner))
    h, o = x.hash[order], x.owner[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.diff(x.first), np.bincount(o[same], minlength=n)


def _blocks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in K.slices(off):
        for x in range(i, j, _TEXTS):
            yield x, min(j, x + _TEXTS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-z))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float) -> Model:
    """Full-batch Adam on the non-negative risk; where the negative part falls under 0 its gradient is followed upwards."""
    every = np.vstack([pos, unl])
    mean, scale = every.mean(0), np.maximum(every.std(0), 1e-3)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (pos, unl))
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    soft = lambda z: np.logaddexp(0, z)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    grad = lambda x, d: np.append(x.T @ d / len(d), d.mean())
    for step in range(1, STEPS + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = soft(zu).mean() - prior * soft(zp).mean()
        g_neg = grad(u, sig(zu)) - prior * grad(p, sig(zp))
        g = prior * grad(p, -sig(-zp)) + g_neg if negative >= 0 else -g_neg
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (STEPS + 1))
        w, b = w - move[:-1], b - move[-1]
    return Model(mean, scale, w, b, prior)


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off, _ = K.strings(batch.column(1))
        for i, j in _blocks(off):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), K.binary_rows(features(buf, off[i : j + 1]), np.arange(j - i + 1))], ["positive", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | float:
    """Model, or a constant score if there is nothing to learn from."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("id")).where(learnable(F.col("id")))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(learnable(F.col("id")) & F.col("y").isNotNull()).groupBy("id").agg(F.min("y").alias("y"))
    known = ids.join(marks, "id", "left").select("id", F.coalesce("y", F.lit(-1)).alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_one, n_none, n_marked = n.get(1, 0), n.get(-1, 0), sum(c for y, c in n.items() if y != -1)
    prior = (n_one + 1) / (n_marked + 2)
    if not n_one:
        return prior
    pick = ((F.col("y") == 1) & (draw(F.col("id"), 4) < min(1.0, positives / n_one))) | ((F.col("y") == -1) & (draw(F.col("id"), 44) < min(1.0, unlabelled / max(1, n_none))))
    chosen = known.where(pick).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(small_side(chosen, 4 * (positives + unlabelled)), "id").select((F.col("y") == 1).alias("positive"), "text")
    got = rows.mapInArrow(_featuriser, "positive boolean, x binary").collect()  # about positives + unlabelled rows of numbers
    got = sorted((r["positive"], bytes(r["x"])) for r in got)
    pos, unl = (np.stack(x) if (x := [np.frombuffer(v, np.float32) for y, v in got if y is want]) else None for want in (True, False))
    return fit_nnpu(pos, pos if unl is None else unl, min(max(prior, 0.01), 0.99))


def _scorer(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, off, _ = K.strings(batch.column(1))
            for i, j in _blocks(off):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(features(buf, off[i : j + 1])).astype(np.float64))], ["id", "score"])

    return work


def score_quality(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: id, score, predicted (1 if score >= cut)."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if isinstance(model, float):
        out = slim.select("id", F.lit(model).alias("score"))
    else:
        out = slim.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), f"id {dict(slim.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
