"""Relational source, read by SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_options(
    url: str,
    query: str,
    split_on: str | None = None,
    low: int | str | None = None,
    high: int | str | None = None,
    parts: int | None = None,
    fetch_rows: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options of a JDBC scan.

    With ``split_on`` the scan runs as ``parts`` range queries on that column;
    rows outside ``low`` to ``high`` fall in the first and the last of them.
    Credentials come in by option (``user``, ``password``), never from code.
    """
    options = {"url": url, "fetchsize": str(fetch_rows), **extra}
    if split_on is None:
        return {**options, "query": query}
    if low is None or high is None or not parts:
        raise ValueError("a split scan needs low, high and parts")
    return {
        **options,
        "dbtable": f"({query}) source",
        "partitionColumn": split_on,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(parts),
    }


def read_sql(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**sql_options(url, query, **options)).load()
