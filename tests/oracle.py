"""Runs a query on both engines and compares the rows as bags."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs between Spark's rows and DuckDB's; empty if nothing does."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
    return ""
