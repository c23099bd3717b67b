"""Order-insensitive comparison of a query with its SQL counterpart."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def canonical(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda at: names[at])
    return [names[at] for at in order], sorted(tuple(_plain(row[at]) for at in order) for row in rows)


def from_spark(frame):
    return canonical(frame.columns, [tuple(row) for row in frame.collect()])


def from_sql(connection, sql: str):
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return canonical(names, result.fetchall())
