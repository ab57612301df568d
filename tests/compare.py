"""Compare a Spark result with DuckDB's answer on the same files."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(con, sql: str):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    where = [columns.index(n) for n in names]
    return names, sorted((tuple(_plain(r[i]) for i in where) for r in result.fetchall()), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both agree, else a short account of where they do not."""
    return compare(df, con, sql)[0]


def compare(df, con, sql: str) -> tuple[str | None, int]:
    s_names, s_rows = spark_rows(df)
    d_names, d_rows = sql_rows(con, sql)
    if s_names != d_names:
        return f"columns {s_names} vs {d_names}", len(s_rows)
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} vs {len(d_rows)}", len(s_rows)
    for a, b in zip(s_rows, d_rows):
        if a != b:
            return f"first difference\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}", len(s_rows)
    return None, len(s_rows)
