"""Next-item data and scoring: sequence preparation, training rows, a self-attentive scorer in NumPy.

Training needs ``torch``, which is optional; preparation and inference don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.functions import arrays as A
from seqrec.functions.text_time import read_time
from seqrec.operators.metadata import first_appearance_ids
from seqrec.operators.sequences import dedup_pairs, min_history
from seqrec.plans.lineage import materialize

MAX_LENGTH, HIDDEN, BLOCKS, HEADS = 50, 128, 2, 2


def timed_reviews(reviews: DataFrame) -> DataFrame:
    """(user_id, item_id, ts) from review text times; rows without a readable time are skipped."""
    return reviews.select("user_id", F.col("book_id").alias("item_id"), read_time(F.col("read_at"), F.col("date_added")).alias("ts")).where("ts IS NOT NULL AND unix_timestamp(ts) <> 0")


def time_sequences(rows: DataFrame, order: list[str], least: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences (user_idx, items), user map, item map): deduplicated, with a minimum history, ids 1-based by first appearance."""
    kept = materialize(min_history(dedup_pairs(rows, ["user_id", "item_id"], order), least), "kept")
    users = first_appearance_ids(kept, "user_id", order).withColumnRenamed("idx", "user_idx")
    items = first_appearance_ids(kept, "item_id", order).withColumnRenamed("idx", "item_idx")
    users, items = materialize(users, "users"), materialize(items, "items")
    rows = kept.join(users, "user_id").join(items, "item_id")
    return rows.groupBy("user_idx").agg(A.ordered_list(F.col("item_idx"), *[F.col(c) for c in order]).alias("items")), users, items


def training_rows(seq: DataFrame, length: int = MAX_LENGTH) -> DataFrame:
    """(user_idx, inputs, targets): the last ``length`` items shifted by one, both padded with 0 on the left."""
    last = seq.select("user_idx", A.trim_last(F.col("items"), length).alias("s")).where(F.size("s") >= 2)
    return last.select("user_idx", A.left_pad(F.slice("s", F.lit(1), F.size("s") - 1), length).alias("inputs"), A.left_pad(F.slice("s", F.lit(2), F.size("s") - 1), length).alias("targets"))


def reject_negatives(rows: DataFrame, n_items: int, seed: int = 1, target: str = "targets") -> DataFrame:
    """Adds ``negatives``: for every real target a uniform item that the row does not hold; 0 where it is padding."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for user, inputs, targets in zip(pdf["user_idx"], pdf["inputs"], pdf[target], strict=True):
                rng = np.random.Generator(np.random.PCG64([seed, int(user)]))
                held = np.unique(np.concatenate([inputs, targets]))
                free = n_items - int((held > 0).sum())
                pick = rng.integers(1, n_items + 1, len(targets))
                while free > 0 and (bad := np.isin(pick, held)).any():
                    pick[bad] = rng.integers(1, n_items + 1, int(bad.sum()))
                out.append(np.where(np.asarray(targets) > 0, pick if free > 0 else 0, 0).astype(np.int32))
            yield pdf.assign(negatives=out)

    return rows.mapInPandas(draw, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", negatives array<int>")


def init_weights(n_items: int, hidden: int = HIDDEN, blocks: int = BLOCKS, length: int = MAX_LENGTH, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights: item and position tables, and per block attention, feed-forward and norms."""
    rng = np.random.Generator(np.random.PCG64(seed))
    r = lambda *s: rng.normal(0, 0.02, s)
    w = {"item": r(n_items + 1, hidden), "pos": r(length, hidden), "norm_g": np.ones(hidden), "norm_b": np.zeros(hidden)}
    w["item"][0] = 0
    for b in range(blocks):
        w |= {f"{b}.{n}": r(hidden, hidden) for n in ("q", "k", "v", "o")}
        w |= {f"{b}.up": r(hidden, 4 * hidden), f"{b}.up_b": np.zeros(4 * hidden), f"{b}.down": r(4 * hidden, hidden), f"{b}.down_b": np.zeros(hidden)}
        w |= {f"{b}.n{i}_{x}": (np.ones if x == "g" else np.zeros)(hidden) for i in (1, 2) for x in "gb"}
    return w


def _norm(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    mean = x.mean(-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(-1, keepdims=True) + 1e-5) * g + b


def encode(w: dict[str, np.ndarray], inputs: np.ndarray, heads: int = HEADS) -> np.ndarray:
    """(batch, length, hidden): causal pre-norm self-attention blocks; padding is never attended to."""
    n, length = inputs.shape
    hidden = w["item"].shape[1]
    x = w["item"][inputs] + w["pos"][-length:]
    pad = inputs == 0
    shut = np.triu(np.ones((length, length), bool), 1)[None] | pad[:, None, :]
    shut = (shut & ~np.eye(length, dtype=bool))[:, None]  # a padded position sees itself, so no row is empty
    for b in range(sum(k.endswith(".q") for k in w)):
        y = _norm(x, w[f"{b}.n1_g"], w[f"{b}.n1_b"])
        q, k, v = ((y @ w[f"{b}.{m}"]).reshape(n, length, heads, -1).transpose(0, 2, 1, 3) for m in "qkv")
        s = np.where(shut, -1e9, q @ k.transpose(0, 1, 3, 2) / np.sqrt(hidden // heads))
        a = np.exp(s - s.max(-1, keepdims=True))
        x = x + ((a / a.sum(-1, keepdims=True)) @ v).transpose(0, 2, 1, 3).reshape(n, length, hidden) @ w[f"{b}.o"]
        y = _norm(x, w[f"{b}.n2_g"], w[f"{b}.n2_b"])
        x = x + np.maximum(y @ w[f"{b}.up"] + w[f"{b}.up_b"], 0) @ w[f"{b}.down"] + w[f"{b}.down_b"]
    return _norm(x, w["norm_g"], w["norm_b"])


def ranking_loss(w: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, negatives: np.ndarray) -> float:
    """Mean binary cross-entropy of target against negative dot products over real positions."""
    h = encode(w, inputs)
    pos, neg = (np.einsum("blh,blh->bl", h, w["item"][x]) for x in (targets, negatives))
    real = targets > 0
    return float((np.logaddexp(0, -pos) + np.logaddexp(0, neg))[real].mean())


def next_items(seq: DataFrame, weights: dict[str, np.ndarray], k: int = 5, length: int = MAX_LENGTH) -> DataFrame:
    """(user_idx, rank, item_idx, score): the k best items after each history, its own items and padding masked."""
    shared = seq.sparkSession.sparkContext.broadcast(weights)
    padded = seq.select("user_idx", "items", A.left_pad(F.col("items"), length).alias("inputs"))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for pdf in frames:
            for lo in range(0, len(pdf), 128):
                some = pdf.iloc[lo : lo + 128]
                if not len(some):
                    continue
                logits = encode(w, np.stack(some["inputs"]))[:, -1] @ w["item"].T
                logits[:, 0] = -np.inf
                for r, items in enumerate(some["items"]):
                    logits[r, np.asarray(items)] = -np.inf
                top = np.argsort(-logits, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(logits, top, 1)
                ok = np.isfinite(value)
                yield pd.DataFrame({"user_idx": np.repeat(some["user_idx"].to_numpy(), ok.sum(1)), "rank": np.concatenate([np.arange(1, m + 1) for m in ok.sum(1)]).astype(np.int32), "item_idx": top[ok].astype(np.int32), "score": value[ok]})

    return padded.mapInPandas(score, "user_idx int, rank int, item_idx int, score double")


def next_for_ids(spark, ids: list[str], item_map: DataFrame, weights: dict[str, np.ndarray], k: int = 5, length: int = MAX_LENGTH) -> DataFrame:
    """(rank, item_id, score) after one history of item ids in order; unknown ids are ignored, no known id gives no row."""
    asked = spark.createDataFrame([(i, str(x)) for i, x in enumerate(ids)], "pos int, item_id string")
    seq = asked.join(item_map, "item_id").groupBy(F.lit(1).alias("user_idx")).agg(A.ordered_list(F.col("item_idx"), F.col("pos")).alias("items"))
    return next_items(seq, weights, k, length).join(item_map, "item_idx").select("rank", "item_id", "score")


def save_dataset(seq: DataFrame, users: DataFrame, items: DataFrame, folder: str) -> None:
    for name, df in (("sequences", seq), ("users", users), ("items", items)):
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load_dataset(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in ("sequences", "users", "items"))


def save_weights(spark, weights: dict[str, np.ndarray], path: str) -> None:
    """One row per array, so that weights live on any file system that Spark reaches."""
    rows = [(k, list(v.shape), bytearray(np.ascontiguousarray(v, np.float64).tobytes())) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").write.mode("overwrite").parquet(path)


def load_weights(spark, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.frombuffer(bytes(r["data"]), np.float64).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def train(rows: DataFrame, n_items: int, epochs: int = 20, rate: float = 0.001, batch: int = 512, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights trained with torch on ``training_rows`` plus ``negatives``; padding carries no loss."""
    try:
        import torch
    except ImportError as e:
        raise RuntimeError("training the self-attentive model needs torch") from e
    from seqrec.operators._torch_next import fit

    return fit(torch, rows, init_weights(n_items, seed=seed), epochs, rate, batch)
