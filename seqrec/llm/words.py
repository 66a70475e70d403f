"""Column expressions shared by the DataFrame-only operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: the bytes that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other scripts stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def blank_words(text: Column) -> Column:
    """Words between blanks of a non-null text, in order; none gives an empty array."""
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK_RUN))


def word_count(text: Column) -> Column:
    """Number of words between blanks; null counts 0."""
    return F.coalesce(F.size(blank_words(text_or_empty(text))), F.lit(0)).cast("long")
