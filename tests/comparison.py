"""Row comparison between Spark and a second engine."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        value = value.to_pydatetime()
    if isinstance(value, dt.datetime) and value.time() == dt.time():
        value = value.date()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return value + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(actual, expected, relative: float = 0.0) -> str | None:
    """The first difference of two (columns, rows) pairs, or None."""
    if sorted(actual[0]) != sorted(expected[0]):
        return f"columns {sorted(actual[0])} != {sorted(expected[0])}"
    left, right = rows_of(*actual), rows_of(*expected)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    names = sorted(actual[0])
    for a, b in zip(left, right):
        for name, x, y in zip(names, a, b):
            if isinstance(x, float) and isinstance(y, (int, float)) and not isinstance(y, bool):
                if x == y or abs(x - y) <= relative * max(abs(x), abs(y)):
                    continue
                return f"{name}: {x!r} != {y!r} in {a} / {b}"
            if x != y:
                return f"{name}: {x!r} != {y!r} in {a} / {b}"
    return None
