"""Connected components of a link table, by contraction with random priorities.

Each round every node points to the neighbour (or itself) of lowest hash; links are rewritten to the
pointed-at nodes, self-links and repeats go, and a constant share of the nodes vanishes. The maps of
all rounds are then composed. Every step is a keyed aggregation or join of narrow rows; nothing is
gathered in one task or the driver, and each round is written to the shared folder.

As soon as at most ``TASK_LINKS`` links are left, counted, one task joins them (16 bytes a link); the result is the
same either way, the smallest node of each component.

Defined cases: links with a null end and self-links say nothing; no links give no rows; repeats are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import kernels as K
from seqrec.plans.lineage import drop, materialize, small_side


#: Links that one task joins in memory.
TASK_LINKS = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if a:
        node, at = np.unique(np.concatenate(a + b), return_inverse=True)
        root = K.spanning(len(node), *np.split(at, 2))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["v", "to"])


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node with a link to another node; ``root`` is the smallest node of its component."""
    edges = materialize(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"), "links")
    size = edges.count()
    both, maps, step = False, [], 0
    while size > task_links:
        if not both:
            edges, both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), True
        rank = lambda c, s=step: F.xxhash64(F.lit(s), F.col(c))
        low = edges.groupBy(F.col("a").alias("v")).agg(F.min_by("b", rank("b")).alias("m"), F.min(rank("b")).alias("h"))
        point = materialize(low.select("v", F.when(F.col("h") < rank("v"), F.col("m")).otherwise(F.col("v")).alias("to")), "points")
        rows = point.count()
        maps.append((point, rows))
        first = edges.join(small_side(point.select(F.col("v").alias("a"), F.col("to").alias("ta")), rows=rows), "a")
        moved = first.join(small_side(point.select(F.col("v").alias("b"), F.col("to").alias("tb")), rows=rows), "b")
        fresh = materialize(moved.where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "links")
        drop(edges.sparkSession, edges)
        edges, size, step = fresh, fresh.count(), step + 1
    last = edges.coalesce(1).mapInArrow(_joined, "v long, to long")
    if not maps:
        return last.select(F.col("v").alias("node"), F.col("to").alias("root"))
    end, rows = materialize(last, "roots"), size
    for before, more in reversed(maps):  # each map is at most as long as the one before
        after = small_side(end.select(F.col("v").alias("to"), F.col("to").alias("far")), rows=rows)
        end, rows = before.join(after, "to", "left").select("v", F.coalesce("far", "to").alias("to")), more
    end = materialize(end, "roots")
    smallest = end.groupBy("to").agg(F.min("v").alias("root"))
    return end.join(small_side(smallest, rows=rows), "to").select(F.col("v").alias("node"), "root")
