"""Comparison of a query's rows with its DuckDB SQL."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def connect(folder=FOLDER):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return "null" if v != v else repr(float(f"{float(v):.12g}") + 0.0)
    if isinstance(v, (datetime.date, datetime.datetime, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return sorted("|".join(map(cell, r)) for r in df[names].itertuples(index=False, name=None))
