"""Compares a registered query with its oracle: names, types, row count and every value."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float" if isinstance(value, float) else "decimal"
    return "str" if isinstance(value, str) else type(value).__name__


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normalized(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple((_kind(r[i]), _plain(r[i])) for i in order) for r in rows]
    return sorted(out, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description of how they differ."""
    spark_rows = normalized(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    oracle_rows = normalized(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(spark_rows) != len(oracle_rows):
        return f"{len(spark_rows)} and {len(oracle_rows)} rows"
    for ours, theirs in zip(spark_rows, oracle_rows):
        if ours != theirs:
            return f"first difference:\n  spark  {str(ours)[:1500]}\n  oracle {str(theirs)[:1500]}"
    return None
