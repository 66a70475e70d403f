"""License scans (DataFrame operations only).

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; shingles are five
words (a shorter text is one shingle). A template with n shingles belongs to the scale L = smallest
power of two >= n. A text's windows at scale L are 2L shingles long and start every L, so each
occurrence lies whole in one window. ``BANDS`` MinHash bands of one row retrieve templates for a
window; a window that holds ``containment`` of a template has Jaccard similarity over 0.2 with it, so
it is missed with probability under 0.8^64 = 7e-7. Exact shingle containment in the window verifies.

Only windows with enough template shingles to pass verification are signed; the rest could not.

Defined cases: null or wordless texts match nothing; rows repeated with the same id and text are
reported once; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.llm.words import ascii_lower, text_or_empty
from seqrec.plans.lineage import small_side

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8
SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Template shingles that may be held as one literal; more are scanned in blocks of templates.
BLOCK_SHINGLES = 20_000

#: Notices by which works name their licence.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}


def license_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SPLIT), lambda w: w != "")


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """Add ``_n_words`` and ``_sh``: the text's five-word shingle hashes by position."""
    words = df.select("*", license_words(text).alias("_w"))
    some = F.expr(f"transform(sequence(0, size(_w) - {SHINGLE}), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]))")
    few = F.when(F.size("_w") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.lit("short"), "_w")))
    return words.select(*df.columns, F.size("_w").alias("_n_words"), F.when(F.size("_w") >= SHINGLE, some).otherwise(few).alias("_sh"))


def minhash(shingles: Column) -> Column:
    """``BANDS`` one-row bands: minimum of a seeded hash over the set."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))))


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """license, template, sh (distinct shingles), n, scale for every template text with a word."""
    rows = [(name, f"{name}#{i}", text) for name, texts in (templates or NOTICES).items() for i, text in enumerate(texts)]
    df = with_shingles(spark.createDataFrame(rows, "license string, template string, text string"), F.col("text"))
    df = df.select("license", "template", F.array_distinct("_sh").alias("sh")).withColumn("n", F.size("sh")).where("n > 0")
    return df.withColumn("scale", F.expr("int(pow(2, ceil(log2(n))))"))


def _hits(block: Column) -> Column:
    """Positions of the shingles that are in ``block``; texts without one cost a single overlap test."""
    at = F.filter(F.sequence(F.lit(0), F.size("_sh") - 1), lambda i: F.array_contains(block, F.get("_sh", i)))
    return F.when(F.arrays_overlap("_sh", block), at).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: id, n_words, matches array<struct<license, template, containment>> sorted by license, template."""
    spark = docs.sparkSession
    known = template_table(spark, templates).withColumn("_need", F.ceil(F.lit(containment) * F.col("n") - 1e-9).cast("int"))
    listed = known.select("scale", "_need", "sh", "n").collect()  # the template table is a parameter, not data
    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("_t"))
    signed = with_shingles(slim, F.col("_t")).select("id", F.xxhash64("_t").alias("_key"), F.col("_n_words").alias("n_words"), "_sh")
    windows = []
    for scale in sorted({r["scale"] for r in listed}):
        own = [r for r in listed if r["scale"] == scale]
        need, hashes = min(r["_need"] for r in own), sorted({h for r in own for h in r["sh"]})
        for at in range(0, len(hashes), BLOCK_SHINGLES):
            block = F.array(*[F.lit(h) for h in hashes[at : at + BLOCK_SHINGLES]])
            windows.append((scale, need if len(hashes) <= BLOCK_SHINGLES else 1, _hits(block)))
    found = signed.select("*", *[w[2].alias(f"_hit{k}") for k, w in enumerate(windows)])

    def starts(k: int, scale: int, need: int) -> Column:
        """Windows of this scale with at least ``need`` hits: hits, doubled by the two windows each lies in, counted by sorted runs."""
        each = F.sort_array(F.flatten(F.transform(f"_hit{k}", lambda p: F.array(F.floor(p / F.lit(scale)).cast("int"), (F.floor(p / F.lit(scale)) - 1).cast("int")))))
        enough = F.filter(each, lambda w, i: F.get(each, i + (need - 1)) == w)
        return F.transform(F.filter(F.array_distinct(enough), lambda w: w >= 0), lambda w: F.struct(F.lit(scale).alias("scale"), (w * scale).alias("start")))

    spots = F.array_distinct(F.flatten(F.array(*[starts(k, s, n) for k, (s, n, _) in enumerate(windows)])))
    rows = found.select("id", "_key", "n_words", "_sh", spots.alias("_spots"))
    rows = rows.select("id", "_key", "n_words", F.when(F.size("_spots") > 0, F.col("_sh")).alias("_sh"), F.explode_outer("_spots").alias("_spot"))
    window = F.array_distinct(F.slice("_sh", F.col("_spot.start") + 1, 2 * F.col("_spot.scale")))
    rows = rows.select("id", "_key", "n_words", F.col("_spot.scale").alias("scale"), window.alias("_win"))
    rows = rows.select("*", F.posexplode_outer(F.when(F.col("scale").isNotNull(), minhash(F.col("_win")))).alias("_band", "_value"))
    bands = known.select("license", "template", F.col("sh").alias("_tsh"), F.col("n").alias("_tn"), F.col("scale").alias("_scale"), F.posexplode(minhash(F.col("sh"))).alias("_tband", "_tvalue"))
    near = rows.join(small_side(bands, 1_000_000), (rows["scale"] == bands["_scale"]) & (rows["_band"] == bands["_tband"]) & (rows["_value"] == bands["_tvalue"]), "left")
    share = F.size(F.array_intersect("_win", "_tsh")) / F.col("_tn")
    match = F.when(F.col("license").isNotNull() & (share >= containment - 1e-9), F.struct("license", "template", share.alias("containment")))
    out = near.select("id", "_key", "n_words", match.alias("_m"))
    best = out.groupBy("id", "_key", "n_words", F.col("_m.license").alias("license"), F.col("_m.template").alias("template")).agg(F.max("_m.containment").alias("containment"))
    each = F.when(F.col("license").isNotNull(), F.struct("license", "template", "containment"))
    return best.groupBy("id", "_key", "n_words").agg(F.sort_array(F.collect_list(each)).alias("matches")).select(F.col("id").alias(id_col), "n_words", "matches")
