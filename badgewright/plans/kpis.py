"""Key figures of a period, each compared with the same figure of earlier windows.

All windows are read in one scan and summed per customer first, so the distinct
counts that follow are plain counts of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from badgewright.fixed import NO_GROWTH
from badgewright.functions.numbers import fixed_text, percent_text, ratio, thousands
from badgewright.operators.filters import Day, as_date, dim_filter, in_days
from badgewright.plans.reports import Filters


def _previous(date: str, first: Day, last: Day) -> Column:
    """The window of equal length that ends the day before ``first``."""
    days = F.date_diff(as_date(last), as_date(first)) + 1
    return F.col(date).between(F.date_sub(as_date(first), days), F.date_sub(as_date(last), days))


def growth(now: Column | str, before: Column | str) -> Column:
    """(now - before) / before, NULL without a base of at least 1."""
    n, b = (F.col(x) if isinstance(x, str) else x for x in (now, before))
    return F.when(b >= 1, ratio(n - b, b))


def _per_customer(fact: DataFrame, windows: dict[str, Column], filters: Filters) -> DataFrame:
    chosen = dim_filter(fact.where(reduce(Column.__or__, windows.values())), filters)
    figures = []
    for name, window in windows.items():
        figures.append(F.sum(F.when(window, F.col("count")).otherwise(F.lit(0))).alias(f"{name}_badges"))
        figures.append(F.max(window).alias(f"{name}_here"))
    return chosen.groupBy("customer_id").agg(*figures)


def kpi_tiles(fact: DataFrame, first: Day, last: Day, filters: Filters = None) -> DataFrame:
    """One row: badges, customers, badges per customer, new customers, 7 and 30 day growth."""
    windows = {
        "now": in_days("date", first, last),
        "previous": _previous("date", first, last),
        "d7": in_days("date", first, last, 7),
        "d30": in_days("date", first, last, 30),
    }
    sums = _per_customer(fact, windows, filters).agg(
        _sum("now_badges").alias("badges"),
        F.count_if("now_here").alias("customers"),
        F.count_if(F.col("now_here") & ~F.col("previous_here")).alias("new_users"),
        _sum("d7_badges").alias("d7"),
        _sum("d30_badges").alias("d30"),
    )
    return sums.select(
        "badges",
        "customers",
        F.round(ratio("badges", "customers"), 2).alias("badges_per_customer"),
        "new_users",
        growth("badges", "d7").alias("growth_7"),
        growth("badges", "d30").alias("growth_30"),
    )


def kpi_tiles_display(tiles: DataFrame) -> DataFrame:
    """The tiles as text."""

    def growth_text(name: str) -> Column:
        return F.coalesce(percent_text(F.lit(100.0) * F.col(name)), F.lit(NO_GROWTH)).alias(name)

    return tiles.select(
        thousands("badges").alias("badges"),
        thousands("customers").alias("customers"),
        fixed_text("badges_per_customer").alias("badges_per_customer"),
        thousands("new_users").alias("new_users"),
        growth_text("growth_7"),
        growth_text("growth_30"),
    )


def kpi_growth(
    fact: DataFrame, first: Day, last: Day, shifts: Sequence[int] = (7, 30, 90), filters: Filters = None
) -> DataFrame:
    """One row: badges now, and badges and growth for each shift in days."""
    windows = {"now": in_days("date", first, last)}
    windows |= {f"d{days}": in_days("date", first, last, days) for days in shifts}
    chosen = dim_filter(fact.where(reduce(Column.__or__, windows.values())), filters)
    sums = chosen.agg(*[_sum(F.when(w, F.col("count"))).alias(name) for name, w in windows.items()])
    figures = [F.col("now").alias("badges")]
    for days in shifts:
        figures.append(F.col(f"d{days}").alias(f"badges_{days}"))
        figures.append(growth("now", f"d{days}").alias(f"growth_{days}"))
    return sums.select(*figures)


def new_customers(fact: DataFrame, first: Day, last: Day, filters: Filters = None) -> DataFrame:
    """Customers of the window who are not in the window just before it.

    One aggregation with a flag per window in place of an anti join of two scans.
    """
    windows = {"now": in_days("date", first, last), "previous": _previous("date", first, last)}
    flags = _per_customer(fact, windows, filters)
    return flags.where(F.col("now_here") & ~F.col("previous_here")).select("customer_id")


def _sum(x: Column | str) -> Column:
    return F.coalesce(F.sum(x), F.lit(0).cast("bigint"))
