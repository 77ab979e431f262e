"""Compares a Spark result with a DuckDB result as multisets of rows."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def as_counter(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(frame, con, sql):
    """(message or None, row count)."""
    rows = frame.collect()
    cursor = con.execute(sql)
    names = [item[0] for item in cursor.description]
    wanted = cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(rows)
    left, right = as_counter(frame.columns, rows), as_counter(names, wanted)
    if left == right:
        return None, len(rows)
    extra, missing = left - right, right - left
    return (f"{len(rows)} rows against {len(wanted)}; columns {sorted(names)}\n"
            f"  only spark {len(extra)}: {list(extra)[:2]}\n"
            f"  only check {len(missing)}: {list(missing)[:2]}")[:3000], len(rows)
