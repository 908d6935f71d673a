"""Side-by-side runs of a query in Spark and its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as comparable text, rows in order."""

    def text(value) -> str:
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "null"
        if isinstance(value, float):
            return repr(value)
        return str(value)

    out = pd.DataFrame({c: [text(v) for v in df[c].astype(object)] for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """What differs, or None."""
    a, b = normal(spark_rows), normal(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} against {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    unequal = (a != b).any(axis=1)
    if unequal.any():
        return f"{int(unequal.sum())} of {len(a)} rows differ, first:\n{a[unequal].head(3)}\n{b[unequal].head(3)}"
    return None
