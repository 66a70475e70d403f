"""Vectorised text kernels over Arrow batches: word hashes, shingles, runs of equal keys.

A batch's strings stay in Arrow's byte buffer; bytes are mapped by a 256-entry table and hashed with
NumPy in slices of whole texts, so memory is bounded by the slice, or by one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_power = np.ones(1, np.uint64)
_unpower = np.ones(1, np.uint64)
_bytes = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _unpower
    if len(_power) < n:
        size = max(n, SLICE_BYTES) + 1
        _power, _unpower = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return _power, _unpower


def byte_table(keep, lower: bool = True) -> np.ndarray:
    """Map of bytes for which ``keep(b)`` holds; others become 0, which separates words."""
    t = np.array([(b or 255) if keep(b) else 0 for b in range(256)], np.uint8)  # 255 is no byte of UTF-8
    if lower:
        t[65:91] = t[97:123]
    return t


#: Words between blanks; words of ASCII letters, digits and non-ASCII characters.
BLANK_TABLE = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
LETTER_TABLE = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


@dataclass
class Words:
    """Words of several texts: hash, first and end byte, number of the text, and where each text's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    first: np.ndarray  # texts + 1 entries


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column, without Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return buf, off, null


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hash_words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts buf[off[i]:off[i + 1]]; positions count from off[0]."""
    n, base = len(off) - 1, int(off[0])
    a = table[buf[base : int(off[-1])]]
    at = off - base
    word = a != 0
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = at[:-1][at[:-1] < len(a)]
    begin[edge] = word[edge]
    start = np.flatnonzero(begin)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    last = at[1:][at[1:] > 0] - 1
    stop[last] = word[last]
    end = np.flatnonzero(stop) + 1
    power, unpower = _powers(len(a) + 1)
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_bytes[a] * power[: len(a)], out=run[1:])
    h = mix((run[end] - run[start]) * unpower[start])
    first = np.searchsorted(start, at)
    return Words(h, start, end, np.repeat(np.arange(n), np.diff(first)), first)


def _fold(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def shingles(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every run of ``k`` words within one text; with ``short``, a text of fewer words is one shingle."""
    h, owner = words.hash, words.owner
    if len(h) >= k:
        inside = owner[: len(h) - k + 1] == owner[k - 1 :]
        out, of = mix(_fold(h, k)[inside]), owner[: len(h) - k + 1][inside]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short:
        count = np.diff(words.first)
        extra, who = [], []
        for m in range(1, k):
            texts = np.flatnonzero(count == m)
            if len(texts):
                rows = h[words.first[texts][:, None] + np.arange(m)]
                x = np.full(len(texts), m, np.uint64)
                for j in range(m):
                    x = (x ^ rows[:, j]) * np.uint64(0xA0761D6478BD642F)
                    x ^= x >> np.uint64(32)
                extra.append(mix(x))
                who.append(texts)
        if extra:
            out, of = np.concatenate([out, *extra]), np.concatenate([of, *who])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return out, of


def distinct_per_owner(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (owner, hash), without repeats."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows values[bounds[i]:bounds[i + 1]] of a contiguous array as a binary column."""
    width = values.dtype.itemsize * int(np.prod(values.shape[1:]))
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 8192) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal keys, of ``least`` rows or more but for the last, from batches of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held:
            last = held[-1].num_rows - 1
            change[0] = any(c[0].as_py() != held[-1].column(held[-1].schema.get_field_index(k))[last].as_py() for k, c in zip(keys, cols, strict=True))
        cut = int(np.flatnonzero(change)[-1]) if change.any() else -1
        if cut < 0 or rows + cut < least:
            held.append(batch)
            rows += batch.num_rows
            continue
        if cut:
            held.append(batch.slice(0, cut))
        yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
        rows = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    change = np.zeros(table.num_rows, bool)
    if table.num_rows:
        change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member of each group) after the links a-b: minimum labels, halved by pointer jumping."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' groups under the links a-b."""
    return join(np.arange(n), a, b)


def forest(n: int, one: np.ndarray, two: np.ndarray, near) -> np.ndarray:
    """Labels of n nodes under ``near(rows, two)``, a boolean matrix asked for a few rows of ``one`` at a time, so that memory holds no pair list."""
    label = np.arange(n)
    step = max(1, (1 << 18) // max(1, len(two)))
    for lo in range(0, len(one), step):
        rows = one[lo : lo + step]
        x, y = np.nonzero(near(rows, two))
        label = join(label, rows[x], two[y])
    return label
