"""Brute-force versions and awkward inputs for the training-data operators."""

import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside themselves, as extra columns of the input.
CLASHES = ["id", "size", "target", "host", "body", "_t", "_w", "row", "sig", "cls", "digest", "_gone", "_doc", "lang_pred", "score", "n_words", "kept", "spans", "items", "token", "part", "line", "lines", "_has_letter", "_copy", "_n", "root", "_d", "_s"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def letter_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def shingle_set(t, k):
    w = blank_words(lower(t))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near_groups(rows, k, percent):
    """id -> (shingles, smallest id of its group), every pair that shares a shingle compared."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    groups, where = Groups(sets), {}
    for i in sorted(sets):
        seen = Counter(j for s in sets[i] for j in where.get(s, ()))
        for j, n in seen.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                groups.join(i, j)
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    return {i: (len(sets[i]), groups.find(i)) for i in sets}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def awkward(seed=0):
    """Rows with nulls, empty and long texts, ties, repeats and control characters."""
    import random

    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "and", "thing", "étre", "ñoño", "über", "ing", "ed", "ation", "x9"])
    para = lambda n: " ".join(word() for _ in range(n))
    base = para(60) + ".\n" + para(80)
    long = "\n".join(para(40) for _ in range(700))
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + " end", "en", "b", 1), (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "de", None, 3),
        (6, "!!! ---", "de", "b", 7), (7, long, "de", "a", 9), (8, long + " tail", "de", "a", 9), (9, "one", None, "c", 3), (10, "one", "fr", "c", 3), (11, "two words", "fr", "c", 9),
        (12, "x" * 300_000, "fr", "c", 1), (13, "a\x00b \x1c c\x0bd \\ \" '", "en", "a", 1), (14, "漢字 仮名 漢字 仮名 漢字", "en", "a", 5), (None, base, "en", "a", 1), (15, "Released under the MIT License.\n" + para(30), "en", "a", 2),
        (16, base, "en", "a", 1), (16, base, "en", "a", 1), (17, "tail\n\n\n" + para(9) + "\n" + para(9), "en", "a", 1),
    ]
    return rows + [(100 + i, para(rng.randint(1, 120)), rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", None]), 1) for i in range(60)]
