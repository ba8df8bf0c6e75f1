"""Comparing a query with its SQL, values in any row order."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NaT or isinstance(value, (float, np.floating)) and np.isnan(value):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return int(value) if float(value).is_integer() else float(f"{value:.8g}")
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


def agree(spark, con, folder, query, sql):
    ours, theirs = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
