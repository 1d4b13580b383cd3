"""Compares a query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    values = [[None if pd.isna(x) else round(float(x), 6) + 0.0 if isinstance(x, float) else int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else str(x) for x in r] for r in df.itertuples(index=False)]
    return sorted(values, key=str)


def compare(spark, sf_dir: str, run, sql: str) -> None:
    got, want = run(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 1e-4 * max(1, abs(q)) for p, q in zip(x, y, strict=True))]
    assert not bad, bad[:3]
