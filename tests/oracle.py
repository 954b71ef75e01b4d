"""Compares a query with its DuckDB twin: columns by name, rows as an unordered collection."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    link = duckdb.connect()
    link.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        target = path if os.path.isfile(path) else f"{path}/*.parquet"
        link.execute(f"create view {name} as select * from '{target}'")
    return link


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


def compare(spark, folder: str, query, sql: str) -> tuple[int, str]:
    """Number of rows and what differs, empty if nothing does."""
    frame = query(spark, folder)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    found = connect(folder).execute(sql)
    names = [c[0] for c in found.description]
    want = rows(names, found.fetchall())
    if sorted(frame.columns) != sorted(names):
        return len(got), f"columns {sorted(frame.columns)} and {sorted(names)}"
    if got == want:
        return len(got), ""
    extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return len(got), f"{len(got)} and {len(want)} rows; only here {extra}; only there {missing}"
