"""Compare a query with its SQL in DuckDB, rows in any order."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted("|".join(map(cell, r)) for r in frame[names].itertuples(index=False, name=None))


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        where = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{where}'")
    return con.sql(sql).df()


def same(spark, query, sql, sf_dir):
    assert rows(query(spark, sf_dir).toPandas()) == rows(oracle(sql, sf_dir))
