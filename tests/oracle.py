"""Runs a query and its SQL side by side, as rows that can be compared."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.stem} as select * from read_parquet('{glob}')")
    return c


def plain(x: object) -> object:
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), str(plain(v))) for k, v in x.items()))
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names: list[str], data: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def same(spark, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    """Whether both sides give the same columns and rows; what differs if not."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = connect(sf_dir).execute(sql)
    names = [x[0] for x in c.description]
    want = rows(names, c.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return True, ""
    a, b = set(got), set(want)
    return False, f"{len(got)} and {len(want)} rows; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
