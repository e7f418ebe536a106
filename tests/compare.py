"""Runs a query and its SQL on the same tables and compares all rows."""

from __future__ import annotations

import os

import duckdb


def tables(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(d):
        path = f"{d}/{t}" + ("/*.parquet" if os.path.isdir(f"{d}/{t}") else "")
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def assert_same(df, connection, sql: str) -> None:
    got = connection.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(repr([plain(dict(zip(names, r, strict=True))[k]) for k in sorted(names)]) for r in got.fetchall())
    ours = sorted(repr([plain(r[k]) for k in sorted(names)]) for r in df.collect())
    assert ours == theirs
