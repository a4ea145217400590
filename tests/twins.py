"""Compares a query with its SQL twin in DuckDB: columns, rows and values, in any order."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def _plain(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return str(int(v)) if float(v).is_integer() else f"{float(v):.9f}"
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(v) for v in r) for r in df[names].itertuples(index=False))


def twin(sql: str, data: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con.execute(sql).df()
