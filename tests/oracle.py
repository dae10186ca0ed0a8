"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(root) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list, list]:
    """Rows found, and up to five rows only one of the two sides has."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(sql_columns), (df.columns, sql_columns)
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(sql_columns, result.fetchall())
    return sum(ours.values()), list((ours - theirs).items())[:5], list((theirs - ours).items())[:5]
