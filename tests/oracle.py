"""Compares a query with its SQL twin on the driver's tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    """A value that both engines agree on."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return float(x) if isinstance(x, int) else x


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark_df, con: duckdb.DuckDBPyConnection, oracle: str) -> str | None:
    """None if both have equal rows, else what differs."""
    want = con.sql(oracle)
    if sorted(want.columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(want.columns)}"
    a, b = rows(spark_df.columns, spark_df.collect()), rows(want.columns, want.fetchall())
    if a == b:
        return None
    odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
    return f"{len(a)} rows and {len(b)}; first differences {odd}"
