"""Spark rows against DuckDB rows, order aside."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    want = sorted([tuple(plain(x) for x in r) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()], key=repr)
    assert got == want
