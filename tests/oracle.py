"""Runs a query on Spark and its SQL on DuckDB and compares the rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "str"
    if isinstance(value, datetime):
        return "timestamp"
    if isinstance(value, date):
        return "date"
    return type(value).__name__


def norm(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, list):
        return tuple(norm(v) for v in value)
    return value


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    theirs = [tuple(norm(row[names.index(c)]) for c in order) for row in cursor.fetchall()]
    mine = [tuple(norm(row[c]) for c in order) for row in df.collect()]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    for i, column in enumerate(order):
        a = {kind(r[i]) for r in mine} - {"null"}
        b = {kind(r[i]) for r in theirs} - {"null"}
        if a != b:
            return f"types of {column}: {a} vs {b}"
    left, right = Counter(mine), Counter(theirs)
    if left != right:
        only_left, only_right = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"values {order}: spark {only_left} duckdb {only_right}"
    return None
