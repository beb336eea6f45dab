"""Compare a Spark result with DuckDB's, column by name, in any row order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def sortable(row):
    return tuple((value is None, str(type(value)) if value is None else "", str(value)) for value in row)


def ordered_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=sortable)


def differences(df, connection, sql: str, limit: int = 5) -> list[str]:
    result = connection.execute(sql)
    duck_names = [column[0] for column in result.description]
    duck_rows = ordered_rows(duck_names, result.fetchall())
    spark_rows = ordered_rows(df.columns, [tuple(row) for row in df.collect()])
    if sorted(duck_names) != sorted(df.columns):
        return [f"columns: {sorted(df.columns)} against {sorted(duck_names)}"]
    found = []
    if len(spark_rows) != len(duck_rows):
        found.append(f"rows: {len(spark_rows)} against {len(duck_rows)}")
    wrong = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ")
        found += [f"{a}\n   {b}" for a, b in wrong[:limit]]
    return found
