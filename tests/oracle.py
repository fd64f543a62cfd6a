"""Compares registered queries with their SQL in DuckDB: columns, rows, and values in any order."""

from __future__ import annotations

import datetime
import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return datetime.datetime(*v.timetuple()[:6])
    return v


def compare(name: str, spark, sf_dir: str, query, sql: str, con) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = df.toPandas().astype(object).where(lambda x: x.notna(), None)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r)) for r in cur.fetchall()]
    if sorted(got.columns) != sorted(cols):
        return f"columns {sorted(got.columns)} and {sorted(cols)}"
    names = sorted(cols)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.to_dict("records")), key=repr)
    b = sorted((tuple(plain(r[c]) for c in names) for r in want), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b):
        if x != y and repr(x) != repr(y):
            return f"{dict(zip(names, x))} and {dict(zip(names, y))}"
    return None
