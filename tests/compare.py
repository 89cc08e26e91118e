"""Runs a query and its SQL on the same tables and compares rows without order."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float | np.floating):
        return None if math.isnan(v) else int(v) if v == int(v) else float(f"{v:.9g}")
    if isinstance(v, list | np.ndarray):
        return str([plain(x) for x in v])
    if isinstance(v, bool | np.bool_):
        return bool(v)
    return int(v) if isinstance(v, int | np.integer) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def same(spark, con, query, sql):
    ours, theirs = query(spark, SF).toPandas(), con.execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
