"""Runs a query and its SQL over the same tables and compares the rows, columns sorted by name."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf: str = DATA):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        path = f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf, name, f, sql, con=None):
    df = f(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or connect(sf)).execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description), (name, df.columns, [d[0] for d in cur.description])
    have, need = set(got), set(want)
    extra, missing = sorted(have - need, key=repr)[:3], sorted(need - have, key=repr)[:3]
    assert got == want, f"{name}: {len(got)} and {len(want)} rows; extra {extra}; missing {missing}"
    return len(got)
