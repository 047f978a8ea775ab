"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(x) -> str:
    if x is None or (isinstance(x, float) and x != x) or x is pd.NA:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(float(x) + 0.0)
    return str(x)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def difference(spark, con, sf: str, fn, sql: str) -> str | None:
    """None if both give the same columns and rows, else a short description."""
    df = fn(spark, sf)
    table = df.toArrow()
    ours = rows(table.column_names, zip(*(c.to_pylist() for c in table.columns)) if table.num_rows else [])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(table.column_names) != sorted(names):
        return f"columns {sorted(table.column_names)} != {sorted(names)}"
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return f"{len(ours)} rows against {len(theirs)}; only ours {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
