"""Comparison of a Spark result with DuckDB's result of the equal SQL."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str, limit: int = 3) -> list[str]:
    """Empty if column names, column types and all values agree."""
    result = connection.execute(sql)
    names, types = [d[0] for d in result.description], [str(d[1]).lower() for d in result.description]
    want = _rows(names, result.fetchall())
    got_types = dict(df.dtypes)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    same = {"bigint": "bigint", "integer": "int", "double": "double", "varchar": "string", "timestamp": "timestamp_ntz"}
    found = [
        f"type of {n}: {got_types[n]} != {t}" for n, t in zip(names, types) if got_types[n] != same.get(t, t)
    ]
    got = _rows(df.columns, [tuple(row) for row in df.collect()])
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    unequal = [(g, w) for g, w in zip(got, want) if g != w]
    if unequal:
        found.append(f"{len(unequal)} unequal rows")
        found += [f"  got  {g}\n  want {w}" for g, w in unequal[:limit]]
    return found
