"""Runs registered queries beside their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if names and rows are equal, else what differs."""
    got = query(spark, sf_dir)
    want = con.sql(sql)
    names = sorted(got.columns)
    if names != sorted(want.columns):
        return f"columns {got.columns} {want.columns}"
    a = Counter(tuple(plain(row[n]) for n in names) for row in got.collect())
    at = [want.columns.index(n) for n in names]
    b = Counter(tuple(plain(row[i]) for i in at) for row in want.fetchall())
    return None if a == b else f"{sum(a.values())} and {sum(b.values())} rows; first differences {list((a - b).items())[:3]} {list((b - a).items())[:3]}"
