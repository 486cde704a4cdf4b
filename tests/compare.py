"""Holds queries against their SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    con.execute("SET TimeZone = 'UTC'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    # whole numbers look alike as longs and, beside nulls, as doubles
    clean = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, float) and not float(x).is_integer() else str(int(x)) if isinstance(x, float) else str(x)
    return sorted((tuple(map(clean, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    kinds = {c: (str(a[c].dtype), str(b[c].dtype)) for c in a.columns if str(a[c].dtype) != str(b[c].dtype) and not a[c].isna().any()}
    x, y = canonical(a), canonical(b)
    if len(x) != len(y):
        return f"rows {len(x)} {len(y)}"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(bad)} of {len(x)} rows, {bad[0]}" if bad else f"types {kinds}" if kinds else None
