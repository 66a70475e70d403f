"""Runs a query and its DuckDB twin over the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return round(x, 6)
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(cell(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
