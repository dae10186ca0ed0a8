"""Aggregations shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from badgewright.functions.numbers import percent_of, ratio

FILL_BLOCK = 65_536


def with_count(df: DataFrame) -> DataFrame:
    """Give a fact without a measure one unit per row."""
    return df if "count" in df.columns else df.withColumn("count", F.lit(1).cast("bigint"))


def unique_users(column: str = "customer_id", approx: bool = False) -> Column:
    return F.approx_count_distinct(column) if approx else F.count_distinct(F.col(column))


def grand_totals(fact: DataFrame, approx: bool = False) -> DataFrame:
    """One row: all badges and all customers of the unfiltered fact."""
    return fact.agg(
        F.sum("count").alias("total_awards"),
        unique_users(approx=approx).alias("unique_users"),
    )


def measures(df: DataFrame, keys: Sequence[str | Column], approx: bool = False) -> DataFrame:
    """Sum of ``count`` and distinct customers per group.

    Spark counts distinct customers in two steps, the first of them keyed by
    group and customer, so a group with most of the rows is spread over all tasks.
    """
    return df.groupBy(*keys).agg(
        F.sum("count").alias("total"),
        unique_users(approx=approx).alias("unique_users"),
    )


def with_shares(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add distribution, penetration and badges per user, against the grand totals."""
    whole = totals.select(F.struct("total_awards", "unique_users")).scalar()
    return df.withColumns(
        {
            "distribution": percent_of("total", whole["total_awards"]),
            "penetration": percent_of("unique_users", whole["unique_users"]),
            "per_user": F.round(ratio("total", "unique_users"), 2),
        }
    )


def customers_per_count(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """How many customers have one row, two rows, and so on (rows, not ``count``)."""
    per_customer = df.groupBy(key).agg(F.count(F.lit(1)).alias("badges"))
    return per_customer.groupBy("badges").agg(F.count(F.lit(1)).alias("users"))


def dense_distribution(observed: DataFrame) -> DataFrame:
    """Every count from 0 to the largest, with its users and the users up to it.

    The windows run in one task, over the observed counts only. These are few
    whatever the data: k different counts need at least k(k+1)/2 rows, so 10^13
    rows have less than five million. The dense rows, of which one busy customer
    can cause far more, are generated in blocks that are spread over the tasks.
    """
    ordered = Window.orderBy("badges")
    steps = observed.select(
        "badges",
        "users",
        F.sum("users").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum_users"),
        F.sum("users").over(Window.partitionBy()).alias("all_users"),
        (F.lag("badges", 1, -1).over(ordered) + 1).alias("gap_start"),
    )
    blocks = steps.withColumn(
        "block", F.explode(F.sequence("gap_start", "badges", F.lit(FILL_BLOCK).cast("bigint")))
    ).repartition("block")
    rows = blocks.withColumn(
        "n", F.explode(F.sequence("block", F.least(F.col("block") + (FILL_BLOCK - 1), F.col("badges"))))
    )
    here = F.col("n") == F.col("badges")
    return rows.select(
        F.col("n").alias("badges"),
        F.when(here, F.col("users")).otherwise(F.lit(0).cast("bigint")).alias("users"),
        F.when(here, F.col("cum_users")).otherwise(F.col("cum_users") - F.col("users")).alias("cum_users"),
        "all_users",
    )


def running_shares(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Share of the total and cumulative share of an aggregate, in order of ``key``.

    For aggregates by a level or another enumerated setting: it runs in one task.
    """
    ordered = Window.orderBy(F.col(key).asc_nulls_last())
    running = F.sum(n).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum(n).over(Window.partitionBy())
    return df.withColumns({"share": percent_of(n, whole), "cum_share": percent_of(running, whole)})


def pivot_sum(
    df: DataFrame,
    row: str,
    column: str,
    values: Sequence[str],
    n: str = "n",
    absent: str = "<NA>",
    other: str = "<other>",
) -> DataFrame:
    """One row per ``row``, one column per value; pairs that do not occur stay NULL.

    The values are given, so the schema is fixed and no job runs to find them. NULL has its own column, named
    ``absent``; all values that are not given are summed in the last column, named ``other``, so a row's columns
    add up to its whole.
    """
    named = F.coalesce(column, F.lit(absent))
    named = F.when(named.isin(list(values)) | (named == absent), named).otherwise(F.lit(other))
    columns = [*dict.fromkeys([*values, absent]), other]
    return df.withColumn(column, named).groupBy(row).pivot(column, columns).agg(F.sum(n))


def in_order(df: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    """Rows in the order of a label list, the position as ``ord``."""
    positions = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("ord", F.array_position(positions, F.col(label))).orderBy("ord")
