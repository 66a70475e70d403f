"""Text and time helpers that survive ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_read_at(text: Column) -> Column:
    """Timestamp of ``EEE MMM dd HH:mm:ss Z yyyy``; weekday and zone are ignored, anything malformed is null."""
    part = F.split(text, " ")
    clock = F.concat_ws(" ", F.get(part, F.lit(1)), F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(5)))
    return F.when(F.size(part) == 6, F.try_to_timestamp(clock, F.lit("MMM dd HH:mm:ss yyyy")))


def read_time(read_at: Column, date_added: Column) -> Column:
    """``read_at``, or ``date_added`` where it is empty."""
    return parse_read_at(F.coalesce(F.nullif(read_at, F.lit("")), date_added))


def label(title: Column, book_id: Column) -> Column:
    """``title (id)``, or the id without a title."""
    return F.coalesce(F.concat(title, F.lit(" ("), book_id, F.lit(")")), book_id)


def four_decimals(x: Column) -> Column:
    return F.format_string("%.4f", x)


def seeded_order(seed: int, *keys: Column) -> Column:
    """Pseudo-random order key that any engine reproduces: md5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
