"""MinHash near-dedup by a signature-coordinate inverted join.

1. One pass over the whole texts gives each document's shingle-set digest and ``COORDS`` MinHash
   coordinates. Documents with the same set form a class, represented by its smallest id.
2. Every class is posted under each (coordinate, value). Values posted once cannot match and fall out.
   Two sets of similarity ``threshold`` agree in at least ``match`` coordinates (all but a share of
   ``MISS`` of them), so a class with m shared values need be posted under its m - match + 1 rarest only
   (prefix); inside a posting list whole signatures are compared and pairs under ``match`` are skipped.
3. What a posting list yields is a spanning forest of its matches, never all its pairs. The forests'
   components are the candidate groups; each class's full set travels once, to its group.
4. In a group all pairs of full sets are compared exactly, by counting common shingles of member-shingle
   incidence blocks; again a forest of the confirmed links leaves the task. Components of those are the result.

Posting lists and groups beyond ``BLOCK`` members are cut in blocks by hash and every pair of blocks is a
task of its own, so no task grows with a hot group, and no link is lost.

Shingle identity is a 64-bit hash. Defined cases: null, empty and wordless texts have no shingles, link
with nothing and are kept; a text of fewer than ``k`` words is one shingle; repeated rows share the id
and so the verdict; a row with null id links with nothing and is kept; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import kernels as K
from seqrec.llm.components import components
from seqrec.plans.lineage import materialize, shuffled, small_side
from seqrec.plans.session import bounded_batches

COORDS = 32
#: Share of the pairs at the very threshold whose signatures may agree in too few coordinates.
MISS = 1e-5
#: Members of a posting list or group that one task compares with each other.
BLOCK = 2048

_rng = np.random.Generator(np.random.PCG64(8))
_MUL = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def least_matches(percent: int, coords: int = COORDS, miss: float = MISS) -> int:
    """Largest t such that a pair of similarity ``percent`` agrees in under t of ``coords`` with probability at most ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(coords + 1):
        below += comb(coords, t) * p**t * (1 - p) ** (coords - t)
        if below > miss:
            return t
    return coords


def _signer(k: int, table: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = K.strings(batch.column(1))
            n_sh, digests, sigs = [], [], []
            for i, j in K.slices(off):
                h, owner = K.shingles(K.hash_words(buf, off[i : j + 1], table), k)
                h, owner = K.distinct_per_owner(h, owner)
                count = np.bincount(owner, minlength=j - i)
                full = np.flatnonzero(count)
                at = np.concatenate([[0], np.cumsum(count[full])[:-1]]).astype(np.int64)
                sig = np.zeros((j - i, COORDS), np.uint64)
                digest = np.zeros((j - i, 2), np.uint64)
                if len(full):
                    for c in range(COORDS):
                        v = (h ^ _ADD[c]) * _MUL[c]
                        v ^= v >> np.uint64(29)
                        sig[full, c] = np.minimum.reduceat(v, at)
                    digest[full, 0] = np.add.reduceat(K.mix(h), at)
                    digest[full, 1] = np.add.reduceat(K.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                n_sh.append(count)
                digests.append(digest)
                sigs.append(sig)
            n = batch.num_rows
            if not n:
                continue
            count = np.concatenate(n_sh).astype(np.int64)
            empty = count == 0

            def rows(parts, empty=empty, n=n):
                whole = K.binary_rows(np.concatenate(parts), np.arange(n + 1))
                return pa.compute.if_else(pa.array(empty), pa.scalar(None, pa.binary()), whole)

            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), rows(digests), rows(sigs)], ["id", "n_shingles", "digest", "sig"])

    return sign


def signatures(docs: DataFrame, k: int, table: np.ndarray = K.BLANK_TABLE) -> DataFrame:
    """(id, n_shingles, digest, sig); digest and sig are null without shingles."""
    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_signer(k, table), "id long, n_shingles long, digest binary, sig binary")


def _matches(sig_a: np.ndarray, sig_b: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros((len(sig_a), len(sig_b)), np.uint8)
    for c in range(sig_a.shape[1]):
        out += sig_a[:, c][:, None] == sig_b[:, c][None, :]
    return out >= least


def _pairs(side: np.ndarray):
    """Members to compare in a block task: the first and the second side; a diagonal task has one side only."""
    two = np.flatnonzero(side == 1)
    one = np.flatnonzero(side == 0)
    return (one, two) if len(two) else (one, one)


def _postings_task(least: int):
    """Forest of signature matches in each posting list (block pair)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in K.runs(batches, ["token", "part"]):
            bound = K.run_bounds(t, ["token", "part"])
            cls, side = t.column("cls").to_numpy(), t.column("side").to_numpy()
            buf, off, _ = K.strings(t.column("sig").cast(pa.large_binary()))
            sig = buf[off[0] : off[-1]].view(np.uint64).reshape(t.num_rows, COORDS) if (off[0] % 8 == 0) else np.frombuffer(buf[off[0] : off[-1]].tobytes(), np.uint64).reshape(t.num_rows, COORDS)
            outs_a, outs_b, near_a, near_b = [], [], [], []
            size = np.diff(bound)
            for m in np.unique(size[(size > 1) & (size <= 8)]):  # short lists, all of one length together
                rows = bound[:-1][size == m][:, None] + np.arange(m)
                for x in range(m):
                    for y in range(x + 1, m):
                        hit = (sig[rows[:, x]] == sig[rows[:, y]]).sum(1) >= least
                        near_a.append(rows[hit, x])
                        near_b.append(rows[hit, y])
            if near_a:
                root = K.spanning(t.num_rows, np.concatenate(near_a), np.concatenate(near_b))
                move = np.flatnonzero(root != np.arange(t.num_rows))
                outs_a.append(cls[move])
                outs_b.append(cls[root[move]])
            for r in np.flatnonzero(size > 8):
                s = slice(bound[r], bound[r + 1])
                one, two = _pairs(side[s])
                own = sig[s]
                root = K.forest(size[r], one, two, lambda p, q, own=own: _matches(own[p], own[q], least))
                move = np.flatnonzero(root != np.arange(size[r]))
                outs_a.append(cls[s][move])
                outs_b.append(cls[s][root[move]])
            a, b = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (outs_a, outs_b))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

    return work


def _common(rows: list[np.ndarray], block: int = 4096) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of all members numbered densely: (member, shingle number, numbers); shingles of one member are left out."""
    member = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    _, number = np.unique(number[shared], return_inverse=True)
    return member[shared], number, int(number.max()) + 1 if len(number) else 0


def links_in_group(rows: list[np.ndarray], one: np.ndarray, two: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x in one, y in two) with 100 * common >= percent * union, from sorted distinct shingle arrays, some rows of ``one`` at a time."""
    member, number, n = _common(rows)
    size = np.array([len(r) for r in rows], np.int64)
    spot1, spot2 = np.full(len(rows), -1), np.full(len(rows), -1)
    spot1[one], spot2[two] = np.arange(len(one)), np.arange(len(two))
    order = np.argsort(number, kind="stable")
    member, number = member[order], number[order]
    common = np.zeros((len(one), len(two)), np.float32)
    step = max(64, (8 << 20) // max(1, len(one) + len(two)))
    for lo in range(0, n, step):
        i, j = np.searchsorted(number, [lo, lo + step])
        mem, num = member[i:j], number[i:j] - lo
        width = min(step, n - lo)
        a, b = np.zeros((len(one), width), np.float32), np.zeros((len(two), width), np.float32)
        in1, in2 = spot1[mem] >= 0, spot2[mem] >= 0
        a[spot1[mem[in1]], num[in1]] = 1
        b[spot2[mem[in2]], num[in2]] = 1
        common += a @ b.T
    for lo in range(0, len(one), 128):  # counts are whole numbers; a few rows at a time keep the wide integers and the pairs small
        both = common[lo : lo + 128].astype(np.int64)
        x, y = np.nonzero((100 * both >= percent * (size[one[lo : lo + 128]][:, None] + size[two][None, :] - both)) & (both > 0))
        yield one[lo + x], two[y]


def _group_task(k: int, table: np.ndarray, percent: int):
    """Forest of exact links in each candidate group (block pair), from the members' whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in K.runs(batches, ["grp", "part"]):
            bound = K.run_bounds(t, ["grp", "part"])
            cls, side = t.column("cls").to_numpy(), t.column("side").to_numpy()
            buf, off, _ = K.strings(t.column("shingles").cast(pa.large_binary()))
            rows = [np.frombuffer(buf[off[i] : off[i + 1]].tobytes(), np.uint64) for i in range(t.num_rows)]
            a, b = [], []
            for r in range(len(bound) - 1):
                s = slice(bound[r], bound[r + 1])
                one, two = _pairs(side[s])
                root = np.arange(s.stop - s.start)
                for x, y in links_in_group(rows[s], one, two, percent):
                    root = K.join(root, x, y)
                move = np.flatnonzero(root != np.arange(len(root)))
                a.append(cls[s][move])
                b.append(cls[s][root[move]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).astype(np.int64)), pa.array(np.concatenate(b).astype(np.int64))], ["a", "b"])

    return work


def _shingler(k: int, table: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = K.strings(batch.column(2))
            for i, j in K.slices(off):
                h, owner = K.distinct_per_owner(*K.shingles(K.hash_words(buf, off[i : j + 1], table), k))
                bound = np.searchsorted(owner, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), K.binary_rows(h, bound)], ["cls", "grp", "shingles"])

    return work


def in_blocks(df: DataFrame, key: str, size: str, block: int = BLOCK) -> DataFrame:
    """Deal the members of each key to tasks: ``part`` and ``side`` for every pair of hash blocks of a large key.

    With g = ceil(size / block) blocks a member goes to g tasks: the diagonal one of its block, and one with
    each other block, where ``side`` tells the lower block from the upper.
    """
    g = f"int(ceil({size} / {block}))"
    mine = f"int(pmod(xxhash64(cls), {g}))"
    spread = f"transform(sequence(0, {g} - 1), o -> struct(int(least(o, {mine}) * {g} + greatest(o, {mine})) AS part, int(IF(o < {mine}, 1, 0)) AS side))"
    one = "array(struct(0 AS part, 0 AS side))"
    return df.withColumn("_deal", F.explode(F.expr(f"CASE WHEN {size} <= {block} THEN {one} ELSE {spread} END"))).select(*df.columns, "_deal.part", "_deal.side")


def candidate_links(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): forests of class pairs that agree in enough coordinates, from ``classes`` (cls, sig)."""
    least = least_matches(percent)
    posts = classes.select("cls", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(COORDS - 1)), lambda j: F.substring("sig", j * 8 + 1, F.lit(8)))).alias("j", "v"))
    posts = posts.select("cls", F.xxhash64("j", "v").alias("token"))
    often = posts.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    shared = posts.join(shuffled(often), "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("posts"))
    prefix = shared.where(F.size("posts") >= least).select("cls", F.explode(F.slice("posts", F.lit(1), F.size("posts") - (least - 1))).alias("p"))
    prefix = materialize(prefix.select("cls", "p.token"), "prefix")
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = in_blocks(prefix.join(shuffled(lists), "token"), "token", "size").join(shuffled(classes), "cls").select("token", "part", "side", "cls", "sig")
    dealt = entries.repartition("token", "part").sortWithinPartitions("token", "part")
    return dealt.mapInArrow(_postings_task(least), "a long, b long")


def exact_links(docs: DataFrame, groups: DataFrame, k: int, percent: int, table: np.ndarray = K.BLANK_TABLE) -> DataFrame:
    """(a, b): forests of links confirmed on full sets. ``groups`` (node, root) names the classes to compare."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = groups.join(shuffled(sizes), "root").select(F.col("node").alias("cls"), F.col("root").alias("grp"), "size")
    members = materialize(members, "members")
    texts = docs.join(small_side(members.select("cls", "grp")), docs["id"] == F.col("cls")).select("cls", "grp", "text")
    sets = texts.mapInArrow(_shingler(k, table), "cls long, grp long, shingles binary")
    sized = sets.join(small_side(sizes.where(F.col("size") > BLOCK).select(F.col("root").alias("grp"), "size")), "grp", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    dealt = in_blocks(sized, "grp", "size").repartition("grp", "part").sortWithinPartitions("grp", "part")
    return dealt.select("grp", "part", "side", "cls", "shingles").mapInArrow(_group_task(k, table, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents link if 100 * common >= percent * union of their sets of ``k``-word shingles.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(slim, k), "signed")
    classes = signed.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.first("sig").alias("sig"), F.min("id").alias("cls"))
    classes = materialize(classes.select("digest", "cls", "sig"), "classes")
    groups = materialize(components(candidate_links(classes.select("cls", "sig"), percent)), "groups")
    roots = components(exact_links(slim, groups, k, percent))
    moved = classes.select("digest", "cls").join(shuffled(roots.withColumnRenamed("node", "cls")), "cls", "left").select("digest", F.coalesce("root", "cls").alias("root"))
    out = signed.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(shuffled(moved), "digest", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one of smallest id."""
    verdict = near_duplicates(docs, id_col, text_col, k, percent)
    gone = verdict.where("NOT kept").select(F.col(id_col).alias("_gone")).distinct()
    gone = materialize(gone, "gone")
    return docs.join(small_side(gone), docs[id_col] == gone["_gone"], "left_anti")
