"""Compares a query with its DuckDB text the way the driver does: columns by name, rows without order."""

import glob
import math
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 6)
    return v if isinstance(v, int) else str(v)


def connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def assert_same(spark, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = connection(folder).execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in order) for r in out.fetchall()), key=repr)
