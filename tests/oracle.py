"""Comparison of a query with its SQL, as multisets of rows by sorted column names."""

import math
import os

import duckdb
import pandas as pd


def views(d):
    con = duckdb.connect()
    for f in os.listdir(d):
        at = f"{d}/{f}" if os.path.isfile(f"{d}/{f}") else f"{d}/{f}/*.parquet"
        con.sql(f"create view {f.split('.')[0]} as select * from '{at}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(float(v)) if isinstance(v, float) else str(v)


def multiset(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None))
