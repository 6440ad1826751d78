"""Compare a Spark query with its DuckDB oracle: row count, column names,
column dtypes and order-insensitive values. Floats must be exactly equal:
both sides already round their float outputs to 6 places."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("int64")
        elif not pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_df, sql: str, con) -> tuple[bool, str]:
    s = spark_df.toPandas()
    d = con.execute(sql).fetchdf()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} sql={sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row counts differ: spark={len(s)} sql={len(d)}"
    sd = {c: str(t) for c, t in s.dtypes.items()}
    dd = {c: str(t) for c, t in d.dtypes.items()}
    if sd != dd:
        return False, f"dtypes differ: spark={sd} sql={dd}"
    a, b = _norm(s), _norm(d)
    for c in a.columns:
        if not a[c].equals(b[c]):
            bad = (a[c] != b[c]).to_numpy().nonzero()[0][:3]
            return False, f"values differ in {c}: spark={a[c].iloc[bad].tolist()} sql={b[c].iloc[bad].tolist()}"
    return True, f"{len(s)} rows"
