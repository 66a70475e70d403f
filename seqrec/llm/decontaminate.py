"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` consecutive words (an item of fewer words is one window).
A window is in a text if all its shingles of ``SHINGLE`` words are, at the same distances; so its rarest
shingle must be (with containment 1 the necessary prefix is one shingle). A first pass counts the
benchmark's shingles over all texts; a second looks up each text's shingles among the windows' rarest
ones only, drops candidates that would begin before or end after the text (position and length bounds)
and verifies the rest word by word.

The benchmark is a query set: it is sent to the executors in blocks of at most ``BLOCK_WINDOWS`` windows,
and each block is scanned against all rows; one block is the usual case. Texts are never shuffled.

Word identity is a 64-bit hash. Defined cases: null and wordless texts are clean and null items match
nothing; repeated rows are each judged; an empty benchmark leaves all rows clean; other columns are
carried by ``drop_contaminated`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import kernels as K
from seqrec.plans.session import bounded_batches

WINDOW = 10
SHINGLE = 3
#: Windows in one broadcast block: 80 bytes of word hashes each and an index of about as much.
BLOCK_WINDOWS = 200_000
SPANS = "array<struct<first: int, last: int>>"


class Lookup:
    """Sorted distinct 64-bit keys behind a bitmap, so that most misses cost one byte read."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, numbers of their keys) of the values that are keys."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        at = np.searchsorted(self.keys, h[maybe])
        at[at == len(self.keys)] = 0
        ok = self.keys[at] == h[maybe]
        return maybe[ok], at[ok]


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off, _ = K.strings(batch.column(1))
        for i, j in K.slices(off):
            w = K.hash_words(buf, off[i : j + 1], K.LETTER_TABLE)
            items, rows = [], []
            for t in range(j - i):
                own = w.hash[w.first[t] : w.first[t + 1]]
                n = min(len(own), WINDOW)
                for s in range(len(own) - n + 1 if n else 0):
                    items.append(batch.column(0)[i + t].as_py())
                    rows.append(own[s : s + n].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.binary())], ["item", "words"])


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the word hashes of every window of every item."""
    slim = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_window_rows, "item string, words binary").distinct()


def _shingles_of(words: np.ndarray, q: int) -> np.ndarray:
    """(windows, shingles) hashes of equally long windows given as rows of word hashes."""
    n, m = words.shape
    flat = np.zeros((n, m - q + 1), np.uint64)
    for s in range(m - q + 1):
        x = np.zeros(n, np.uint64)
        for j in range(q):
            x = (x ^ words[:, s + j]) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        flat[:, s] = K.mix(x)
    return flat


class Index:
    """Windows of one block by length; ``weigh`` picks each window's rarest shingle."""

    def __init__(self, items: list[str], words: list[bytes]):
        self.items = np.array(sorted(set(items)), object)
        number = {x: i for i, x in enumerate(self.items)}
        lengths = np.array([len(w) // 8 for w in words], np.int64)
        self.groups = []  # (window length, shingle length, words, item numbers, shingles)
        for m in np.unique(lengths):
            rows = np.flatnonzero(lengths == m)
            own = np.frombuffer(b"".join(words[r] for r in rows), np.uint64).reshape(len(rows), m)
            q = int(min(m, SHINGLE))
            self.groups.append((int(m), q, own, np.array([number[items[r]] for r in rows], np.int64), _shingles_of(own, q)))
        self.lookups = {q: Lookup(np.concatenate([g[4].ravel() for g in self.groups if g[1] == q])) for q in {g[1] for g in self.groups}}
        self.prefix: list = []

    def weigh(self, counts: dict[tuple[int, int], int]) -> None:
        """counts: (shingle length, key number) -> occurrences in all texts."""
        self.prefix = []
        for m, q, own, item, sh in self.groups:
            keys = np.searchsorted(self.lookups[q].keys, sh)
            many = np.zeros(len(self.lookups[q].keys), np.int64)
            for (p, k), c in counts.items():
                if p == q:
                    many[k] = c
            weight = many[keys]
            rare = np.argmin(weight, axis=1)  # the first of the rarest
            key = sh[np.arange(len(sh)), rare]
            order = np.argsort(key, kind="stable")
            look = Lookup(key)
            self.prefix.append((m, q, own, item, look, order, np.searchsorted(key[order], look.keys), np.searchsorted(key[order], look.keys, "right"), rare))


def _every(words: K.Words, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of all shingles of q words inside one text."""
    n = len(words.hash) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(words.owner[:n] == words.owner[q - 1 :])
    return K.mix(K._fold(words.hash, q)[inside]), inside


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = {q: np.zeros(len(x.keys), np.int64) for q, x in index.lookups.items()}
        for batch in batches:
            buf, off, _ = K.strings(batch.column(0))
            for i, j in K.slices(off):
                words = K.hash_words(buf, off[i : j + 1], K.LETTER_TABLE)
                for q, look in index.lookups.items():
                    total[q] += np.bincount(look.find(_every(words, q)[0])[1], minlength=len(look.keys))
        for q, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), q, np.int32)), pa.array(k.astype(np.int64)), pa.array(n[k])], ["q", "k", "n"])

    return count


def scan(words: K.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, item number) of all verified occurrences."""
    first, last, found = [], [], []
    seen: dict[int, tuple] = {}
    for m, q, own, item, look, order, lo, hi, rare in index.prefix:
        h, pos = seen.setdefault(q, _every(words, q))
        at, key = look.find(h)
        times = hi[key] - lo[key]
        if not len(at):
            continue
        win = order[np.repeat(lo[key], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        anchor = np.repeat(pos[at], times)
        start = anchor - rare[win]
        text = words.owner[anchor]
        ok = (start >= words.first[text]) & (start + m <= words.first[text + 1])
        start, win = start[ok], win[ok]
        same = np.ones(len(start), bool)
        for x in range(m):
            same &= words.hash[start + x] == own[win, x]
        first.append(start[same])
        last.append(start[same] + m)
        found.append(item[win[same]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(first), join(last), join(found)


def _judge(buf: np.ndarray, off: np.ndarray, index: Index):
    """Per text: words, covered flag of each word, item numbers found."""
    words = K.hash_words(buf, off, K.LETTER_TABLE)
    first, last, found = scan(words, index)
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return words, np.cumsum(edge)[:-1] > 0, words.owner[first] if len(first) else first, found


def _marker(shared):
    """Adds one block's hits to the columns (…, text, spans, items)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            buf, off, _ = K.strings(batch.column(1))
            for i, j in K.slices(off):
                words, hit, owner, found = _judge(buf, off[i : j + 1], index)
                old_spans, old_items = batch.column(3).slice(i, j - i).to_pylist(), batch.column(4).slice(i, j - i).to_pylist()
                for t in range(j - i):
                    for s in old_spans[t] or ():
                        hit[words.first[t] + s["first"] : words.first[t] + s["last"] + 1] = True
                begin = hit.copy()
                begin[1:] &= ~(hit[:-1] & (words.owner[1:] == words.owner[:-1]))
                stop = hit.copy()
                stop[:-1] &= ~(hit[1:] & (words.owner[1:] == words.owner[:-1]))
                a, b = np.flatnonzero(begin), np.flatnonzero(stop)
                who = words.owner[a]
                bound = np.searchsorted(who, np.arange(j - i + 1)).astype(np.int32)
                base = words.first[who]
                pairs = pa.StructArray.from_arrays([pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], ["first", "last"])
                names: list[list[str]] = [list(x or ()) for x in old_items]
                for t, x in sorted(set(zip(owner.tolist(), found.tolist(), strict=True))):
                    names[t].append(index.items[x])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bound), pairs), pa.array(names, pa.list_(pa.string()))],
                    ["id", "text", "n_words", "spans", "items"],
                )

    return mark


def _filter(shared, column: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            buf, off, _ = K.strings(batch.column(column))
            clean = np.ones(batch.num_rows, bool)
            for i, j in K.slices(off):
                words = K.hash_words(buf, off[i : j + 1], K.LETTER_TABLE)
                first = scan(words, index)[0]
                clean[i + words.owner[first]] = False
            yield batch.filter(pa.array(clean))

    return keep


def indexes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, block: int):
    """Broadcast indexes of the benchmark's blocks, weighted by the shingles' frequency over all of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    windows = benchmark_windows(benchmark, item_col, item_text_col).cache()
    blocks = max(1, -(-windows.count() // block))
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()  # at most about `block` windows
        if not rows:
            continue
        index = Index([r["item"] for r in rows], [bytes(r["words"]) for r in rows])
        plain = spark.sparkContext.broadcast(index)
        counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_counter(plain), "q int, k long, n long").groupBy("q", "k").agg(F.sum("n").alias("n")).collect()
        index.weigh({(r["q"], r["k"]): r["n"] for r in counted})
        yield spark.sparkContext.broadcast(index)
    windows.unpersist()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, spans (word positions that are hit), items (ids of the items found)."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = f"id {kind}, text string, n_words long, spans {SPANS}, items array<string>"
    any_index = False
    for shared in indexes(docs, benchmark, text_col, item_col, item_text_col, block):
        out, any_index = out.mapInArrow(_marker(shared), schema), True
    if not any_index:
        out = out.mapInArrow(_marker(docs.sparkSession.sparkContext.broadcast(Index([], []))), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; a narrow pass for each block."""
    out = docs
    for shared in indexes(docs, benchmark, text_col, item_col, item_text_col, block):
        out = out.mapInArrow(_filter(shared, docs.columns.index(text_col)), docs.schema)
    return out
