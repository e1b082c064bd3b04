"""Runs a query in Spark and its SQL counterpart in DuckDB and compares the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

# The given tables.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(connection: duckdb.DuckDBPyConnection, result: DataFrame, sql: str) -> str | None:
    """NULL if both sides give the same columns, types of values and rows, else what differs."""
    relation = connection.execute(sql)
    theirs_columns = [column[0] for column in relation.description]
    if sorted(theirs_columns) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(theirs_columns)}"
    theirs = _rows(theirs_columns, relation.fetchall())
    ours = _rows(result.columns, [tuple(row) for row in result.collect()])
    if ours == theirs:
        return None
    extra, missing = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {extra}; only SQL {missing}"
