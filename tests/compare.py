"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = Path("/root/testdata/sf0.001")


def same(spark, query, sql: str) -> str:
    """What differs between the two results, '' if nothing does."""
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    a, b = query(spark, str(TABLES)).toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    order = lambda d: d[sorted(d.columns)].sort_values(sorted(d.columns), key=lambda c: c.map(str)).reset_index(drop=True)
    a, b = order(a), order(b)
    for c in a.columns:
        if not (a[c].map(str) == b[c].map(str)).all():
            if not (pd.api.types.is_numeric_dtype(a[c]) and np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True, rtol=1e-12, atol=1e-12)):
                return f"values of {c}"
    return ""
