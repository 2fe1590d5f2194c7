"""Runs a query and its SQL on the same tables and compares the sorted rows."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, entry, name, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    got = df.toPandas()
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    cols = sorted(got.columns)
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.integer, np.floating, Decimal)):
            return repr(float(x))
        return str(x)

    plain = lambda d: sorted(tuple(map(cell, r)) for r in d[cols].itertuples(index=False))
    a, b = plain(got), plain(want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
