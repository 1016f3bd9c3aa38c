"""Compares a Spark frame with DuckDB's answer, rows in any order, numbers to ten digits."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if x is None or isinstance(x, (bool, int)):
        return x
    try:
        return float(f"{float(x):.9g}") if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def answer(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return sorted(columns), rows(columns, cur.fetchall())


def same(df, sf_dir: str, sql: str) -> None:
    columns, want = answer(sf_dir, sql)
    assert sorted(df.columns) == columns
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
