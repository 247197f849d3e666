"""Runs a query and its SQL side by side and compares all rows."""

import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else str(v)


def connect(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    columns = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    right = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert left == right
