"""Compares a Spark result with DuckDB's for the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)

    def one(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(one(v) for v in row) for row in df[columns].astype(object).itertuples(index=False)), key=str)
