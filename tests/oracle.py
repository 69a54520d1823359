"""Holding a query against DuckDB: same columns, same rows in any order, equal values."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str, most: int = 5) -> list[str]:
    """What differs, in words; empty if nothing does."""
    rel = con.sql(sql)
    names, theirs = list(rel.columns), rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, theirs)
    out = [] if len(a) == len(b) else [f"{len(a)} and {len(b)} rows"]
    out += [f"{x} and {y}" for x, y in zip(a, b) if x != y]
    return out[:most]
