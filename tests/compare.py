"""Runs a query and its DuckDB equivalent over the same tables and compares schemas and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        at = Path(sf_dir, f"{name}.parquet")
        if at.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at / '*.parquet' if at.is_dir() else at}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(spark, query, sql: str, sf_dir: str) -> list:
    """The first rows that only one side has; raises on other columns."""
    df = query(spark, sf_dir)
    con = connect(sf_dir).execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, con.fetchall())
    if ours == theirs:
        return []
    a, b = set(ours), set(theirs)
    return [len(ours), len(theirs), sorted(a - b)[:3], sorted(b - a)[:3]]
