"""Compare a Spark result with a DuckDB result: columns by name, rows in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable", na_position="last").reset_index(drop=True)


def _plain(s: pd.Series) -> pd.Series:
    if str(s.dtype).startswith("datetime64"):
        return s.astype("datetime64[us]")
    if s.dtype == object and s.map(lambda v: hasattr(v, "isoformat")).any():
        return pd.to_datetime(s).astype("datetime64[us]")
    return s


def differences(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} != {len(duck_df)}"
    a, b = spark_df.apply(_plain), duck_df.apply(_plain)
    for c in a.columns:
        if len(a) and a[c].dtype.kind != b[c].dtype.kind and not (a[c].isna().all() and b[c].isna().all()):
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
    a, b = ordered(a), ordered(b)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = same[~same].index[:3]
            return f"{c}: {(~same).sum()} differ, e.g. {[(a[c][i], b[c][i]) for i in at]}"
    return None
