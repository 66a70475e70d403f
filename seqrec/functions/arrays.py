"""Sequence expressions; all stay inside one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_list(value: Column, *keys: Column) -> Column:
    """Aggregate: values in key order, whatever the shuffle's order."""
    pair = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["v"])


def consecutive_dedup(items: Column) -> Column:
    """Drop an element equal to the one before. The first stays; after a null any stays; a null after a non-null goes."""

    def keep(x, i):
        before = F.get(items, i - 1)
        return (i == 0) | before.isNull() | (x != before)

    return F.filter(items, keep)


def trim_first(items: Column, n: int = 200) -> Column:
    return F.slice(items, 1, n)


def trim_last(items: Column, n: int = 200) -> Column:
    """The last n elements (all, if there are fewer)."""
    size = F.size(items)
    return F.slice(items, F.greatest(size - n, F.lit(0)) + 1, n)


def trim(items: Column, n: int = 200, keep: str = "first") -> Column:
    return trim_first(items, n) if keep == "first" else trim_last(items, n)


def left_pad(items: Column, n: int, fill: int = 0) -> Column:
    """The last n elements, filled up with ``fill`` on the left."""
    last = trim_last(items, n)
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(last), F.lit(0))), last)


def pair_count(size: Column, window: int) -> Column:
    """Skip-gram pairs of a sequence in closed form; 0 up to length 1."""
    m = F.least(F.lit(window), size - 1).cast("long")
    return F.when(size > 1, 2 * m * size - m * (m + 1)).otherwise(F.lit(0)).cast("long")


def window_pairs(items: Column, window: int) -> Column:
    """array<struct<target, context>>: every element with its neighbours up to ``window`` away; no shuffle."""
    last = F.size(items) - 1

    def around(target, i):
        spots = F.filter(F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, last)), lambda j: j != i)
        return F.transform(spots, lambda j: F.struct(target.alias("target"), F.get(items, j).alias("context")))

    return F.when(F.size(items) > 1, F.flatten(F.transform(items, around)))
