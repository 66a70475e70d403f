"""Language identification by nearest centroid.

Byte trigrams of letters (A-Z and Latin-1 capitals lower-cased, all else a word break) are hashed to
``DIMS`` counts, weighted log(1 + tf) * idf and normalised. Each language gets up to ``CLUSTERS`` centroids by
spherical k-means over at most about ``PER_LANGUAGE`` texts (the documented bound of the fit). A text takes
the language of the centroid of highest cosine, and is rejected if that cosine is under a floor
fitted to training texts of its length.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and rejected; ties go to
the first language in code-point order; repeated rows are each judged; with nothing to learn from, every
text is ``und``; other columns are carried by ``keep_known`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import kernels as K
from seqrec.llm.folds import learnable, per_group_sample
from seqrec.plans.lineage import materialize
from seqrec.plans.session import bounded_batches

DIMS = 8192
CLUSTERS = 4
#: About as many training texts of each language are used, drawn by id hash.
PER_LANGUAGE = 400
#: A text is rejected under this share of the lowest training cosine at its length.
FLOOR_SHARE = 0.25
_TEXTS = 256
_TABLE = K.byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def trigram_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, DIMS) counts of hashed trigrams whose middle byte is no word break."""
    n = len(off) - 1
    a = _TABLE[buf[off[0] : off[-1]]].astype(np.uint32)
    if len(a) > 1:
        capital = np.flatnonzero((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E)) + 1
        a[capital] += 0x20
    first = off[:-1] - off[0]
    owner = np.repeat(np.arange(n), np.diff(off))
    left, right = np.zeros_like(a), np.zeros_like(a)
    left[1:], right[:-1] = a[:-1], a[1:]
    left[first[first < len(a)]] = 0
    ends = (off[1:] - off[0])[np.diff(off) > 0] - 1
    right[ends] = 0
    use = a != 0
    with np.errstate(over="ignore"):
        h = (left[use] * np.uint32(0x9E3779B1)) ^ (a[use] * np.uint32(0x85EBCA77)) ^ (right[use] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
    return np.bincount(owner[use] * DIMS + (h % np.uint32(DIMS)).astype(np.int64), minlength=n * DIMS).reshape(n, DIMS)


def text_blocks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in K.slices(off):
        for x in range(i, j, _TEXTS):
            yield x, min(j, x + _TEXTS)


@dataclass
class Model:
    langs: list[str]
    of: np.ndarray  # language number of each centroid
    centroids: np.ndarray  # (centroids, DIMS), unit rows
    idf: np.ndarray
    floors: np.ndarray  # by floor(log2(1 + trigrams))

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, rejected) of each row of trigram counts."""
        x = np.log1p(counts).astype(np.float32) * self.idf
        norm = np.linalg.norm(x, axis=1)
        cos = (x @ self.centroids.T) / np.maximum(norm, 1e-12)[:, None]
        best = np.argmax(cos, axis=1)  # centroids are in language order
        top = np.clip(cos[np.arange(len(cos)), best], 0, 1)
        size = np.minimum(np.log2(1 + counts.sum(1)).astype(int), len(self.floors) - 1)
        return self.of[best], top, top < self.floors[size]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off, _ = K.strings(batch.column(1))
        for i, j in text_blocks(off):
            counts = trigram_counts(buf, off[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), K.binary_rows(counts.astype(np.uint16), np.arange(j - i + 1))], ["lang", "tf"])


def _dims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(DIMS, np.int64)
    for batch in batches:
        for v in batch.column(0).to_pylist():
            seen += np.frombuffer(v, np.uint16) > 0
    k = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(seen[k])], ["k", "n"])


def _cluster(idf: np.ndarray):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tf", kind="stable")
        counts = np.stack([np.frombuffer(v, np.uint16) for v in pdf["tf"]])
        x = np.log1p(counts).astype(np.float32) * idf
        norm = np.linalg.norm(x, axis=1)
        x, counts = x[norm > 0] / norm[norm > 0][:, None], counts[norm > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "sizes": [], "cosines": []})
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]
        c = unit(x.mean(0, keepdims=True))
        while len(c) < min(CLUSTERS, len(x)):  # farthest texts first, long ones before short
            reach = (x @ c.T).max(1)
            c = np.vstack([c, x[np.argmin(reach)]])
        for _ in range(12):
            label = np.argmax(x @ c.T, axis=1)
            kept = [k for k in range(len(c)) if (label == k).any()]
            c = unit(np.stack([x[label == k].sum(0) for k in kept]))
        cos = (x @ c.T).max(1)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [r.tobytes() for r in c], "sizes": [counts.sum(1).astype(np.int64).tobytes()] + [b""] * (len(c) - 1), "cosines": [cos.astype(np.float64).tobytes()] + [b""] * (len(c) - 1)})

    return fit


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Model from the learnable rows with text and language; None if there are none.

    Clustering runs in one task per language over its bounded sample; the driver gets document
    frequencies (``DIMS`` numbers) and the centroids.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(learnable(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = per_group_sample(rows, "id", "lang", per_language, 5)
    vectors = materialize(sample.select("lang", "text").mapInArrow(_vectors, "lang string, tf binary"), "vectors")
    n = vectors.count()
    if not n:
        return None
    seen = np.zeros(DIMS, np.float64)
    for r in vectors.select("tf").mapInArrow(_dims, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        seen[r["k"]] = r["n"]
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.05)
    got = vectors.groupBy("lang").applyInPandas(_cluster(idf), "lang string, centroid binary, sizes binary, cosines binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    langs = sorted({r["lang"] for r in got})
    size, cos = (np.concatenate([np.frombuffer(r[c], t) for r in got]) for c, t in (("sizes", np.int64), ("cosines", np.float64)))
    bins = np.log2(1 + size).astype(int)
    floors = np.array([cos[bins <= max(b, bins.min())].min() for b in range(32)])  # a shorter text's floor holds for longer ones
    for b in range(32):  # of its own length, where texts of it were seen
        if (bins == b).sum() >= 20:
            floors[b] = cos[bins == b].min()
    return Model(langs, np.array([langs.index(r["lang"]) for r in got]), np.stack([np.frombuffer(r["centroid"], np.float32) for r in got]), idf, floors * FLOOR_SHARE)


def _predict(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, off, _ = K.strings(batch.column(1))
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in text_blocks(off):
                lang, cos, out = model.score(trigram_counts(buf, off[i : j + 1]))
                ok = letter[i:j]
                names = np.where(ok, np.array(model.langs, object)[lang], "und")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(np.where(ok, cos, 0.0).astype(np.float64)), pa.array(out | ~ok)], ["id", "lang_pred", "score", "rejected"])

    return work


HAS_LETTER = r"\p{L}"


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (cosine), rejected."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(HAS_LETTER), F.lit(False)).alias("letter"))
    if model is None:
        return slim.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(slim.dtypes)["id"]
    return slim.mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def _filter(shared, text_at: int, flag_at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, off, _ = K.strings(batch.column(text_at))
            ok = batch.column(flag_at).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in text_blocks(off):
                ok[i:j] &= ~model.score(trigram_counts(buf, off[i : j + 1]))[2]
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != flag_at], [x for k, x in enumerate(batch.schema.names) if k != flag_at]).filter(pa.array(ok))

    return keep


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows; one narrow pass. Without a model every row goes."""
    if model is None:
        return docs.where(F.lit(False))
    flag = "_" * (1 + max(map(len, docs.columns)))  # longer than any column of the input
    flagged = docs.select("*", F.coalesce(F.col(text_col).rlike(HAS_LETTER), F.lit(False)).alias(flag))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return flagged.mapInArrow(_filter(shared, docs.columns.index(text_col), len(docs.columns)), docs.schema)
