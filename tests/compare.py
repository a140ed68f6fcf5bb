"""Rows of a Spark query and of SQL in DuckDB, in a form that can be compared."""

import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple[str, ...]]:
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else f"{v:.9f}"
        return str(v)

    return sorted(tuple(map(text, r)) for r in frame[columns].astype(object).itertuples(index=False))


def in_duckdb(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con.sql(sql).df()
