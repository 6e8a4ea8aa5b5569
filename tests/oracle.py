"""Compares registered queries with their DuckDB twins."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1).copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else repr(float(v)))
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        bad = a[c] != b[c]
        if bad.any():
            return f"column {c}: {bad.sum()} of {len(a)} differ, e.g. {a[bad].iloc[0].to_dict()} != {b[bad].iloc[0].to_dict()}"
    return None
