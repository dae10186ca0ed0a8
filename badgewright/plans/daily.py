"""Two small tables per day and dimension value that answer any range of days without reading the fact again.

``daily_sketches`` keeps the sum and a sketch of the customers: sketches of days merge to that of a window, and those of
two windows give the customers of one that are not in the other. ``cumulative`` keeps running sums:
the sum of a range is the difference of two rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from badgewright.fixed import PERIODS
from badgewright.functions.numbers import ratio
from badgewright.operators.filters import Day, as_date, date_range, in_days
from badgewright.operators.periods import as_rows, every_period
from badgewright.plans.kpis import growth

# Entries of a sketch as a power of two. Up to that many customers are counted exactly; beyond, the estimate has a relative
# standard error of about one over the root of the entries (0.8 %).
LOG_ENTRIES = 14


def standard_error(log_entries: int = LOG_ENTRIES) -> float:
    """Relative standard error of an estimate of more customers than a sketch has entries."""
    return (2**log_entries - 2) ** -0.5


def daily_sketches(fact: DataFrame, by: Sequence[str] = ("label",), log_entries: int = LOG_ENTRIES) -> DataFrame:
    """Per day and value of ``by``: ``n``, the sum of ``count``, and ``customers``, a sketch of the customers.

    Sketches are made per task and merged, so a day or label with most of the rows is no hot spot. A sketch holds eight
    bytes per customer up to its entries.
    """
    return fact.groupBy("date", *by).agg(
        F.sum("count").alias("n"), F.theta_sketch_agg("customer_id", log_entries).alias("customers")
    )


def _union(window: Column, log_entries: int) -> Column:
    return F.theta_union_agg(F.when(window, F.col("customers")), log_entries)


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("bigint"))


def sketched_measures(
    sketches: DataFrame, first: Day, last: Day, by: Sequence[str] = ("label",), log_entries: int = LOG_ENTRIES
) -> DataFrame:
    """Badges and distinct customers per group in a window; without ``by``, of all groups together."""
    chosen = date_range(sketches, first, last)
    merged = F.theta_union_agg("customers", log_entries)
    return chosen.groupBy(*by).agg(F.sum("n").alias("total"), F.theta_sketch_estimate(merged).alias("unique_users"))


def sketched_tiles(sketches: DataFrame, first: Day, last: Day, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """The tiles of ``kpis.kpi_tiles`` from the sketches: the new customers are one window's sketch without the other's."""
    days = F.date_diff(as_date(last), as_date(first)) + 1
    before = F.col("date").between(F.date_sub(as_date(first), days), F.date_sub(as_date(last), days))
    windows = {"now": in_days("date", first, last), "d7": in_days("date", first, last, 7), "d30": in_days("date", first, last, 30)}
    chosen = sketches.where(windows["now"] | windows["d7"] | windows["d30"] | before)
    sums = chosen.agg(
        *[F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0).cast("bigint")).alias(name) for name, w in windows.items()],
        _union(windows["now"], log_entries).alias("here"),
        _union(before, log_entries).alias("there"),
    )
    counted = sums.withColumns(
        {"customers": _estimate(F.col("here")), "new_users": _estimate(F.theta_difference("here", "there"))}
    )
    return counted.select(
        F.col("now").alias("badges"),
        "customers",
        F.round(ratio("now", "customers"), 2).alias("badges_per_customer"),
        "new_users",
        growth("now", "d7").alias("growth_7"),
        growth("now", "d30").alias("growth_30"),
    )


def _windows(spark, as_of: Column | str, codes: Iterable[str]) -> DataFrame:
    """(code, compare, is_current, low, high): every period and the one it is compared with, from one constant row."""
    both = F.array(
        F.struct(F.lit(True).alias("is_current"), F.col("start").alias("low"), F.col("end").alias("high")),
        F.struct(F.lit(False).alias("is_current"), F.col("cmp_start").alias("low"), F.col("cmp_end").alias("high")),
    )
    table = spark.range(1).select(as_rows(every_period(as_date(as_of), codes)))
    return table.select("code", "compare", F.inline(both))


def period_customers(
    sketches: DataFrame, as_of: Column | str, codes: Iterable[str] = PERIODS.values(), log_entries: int = LOG_ENTRIES
) -> DataFrame:
    """Distinct customers of every period and of the one it is compared with.

    Sketches are merged per day first; each period is spelt out as its days, so the range condition is an equality
    between two relations of days.
    """
    daily = sketches.groupBy("date").agg(F.theta_union_agg("customers", log_entries).alias("customers"))
    days = _windows(sketches.sparkSession, as_of, codes).select(
        "code", "compare", "is_current", F.explode(F.sequence("low", "high")).alias("date")
    )
    current = F.col("is_current")
    return days.join(daily, "date", "left").groupBy("code", "compare").agg(
        _estimate(_union(current, log_entries)).alias("current"),
        _estimate(_union(~current, log_entries)).alias("comparison"),
    )


def cumulative(fact: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Per value of ``by`` and day: ``cum``, the sum of ``count`` up to that day.

    There is a row for every day from the one before the first to the last, so the sum up to any day is found by equality.
    The windows run per group over its days, which are as few as the calendar has, whatever the fact.
    """
    daily = fact.groupBy(*by, "date").agg(F.sum("count").alias("n"))
    span = daily.agg(F.min("date").alias("low"), F.max("date").alias("high"))
    first, last = (span.select(c).scalar() for c in ("low", "high"))
    spine = daily.select(*by).distinct().withColumn("date", F.explode(F.sequence(F.date_sub(first, 1), last)))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by] + [F.col("d.date") == F.col("s.date")]
    dense = spine.alias("s").join(daily.alias("d"), same, "left").select(*[F.col(f"s.{c}") for c in by], "s.date", "n")
    upto = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dense.select(*by, "date", F.coalesce(F.sum("n").over(upto), F.lit(0).cast("bigint")).alias("cum"))


def _upto(prefix: DataFrame, day: Column) -> Column:
    """The table's day that holds the sum up to ``day``."""
    span = prefix.agg(F.min("date").alias("low"), F.max("date").alias("high"))
    low, high = (span.select(c).scalar() for c in ("low", "high"))
    return F.least(F.greatest(day, low), high)


def _differences(prefix: DataFrame, windows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(keys, is_current, by, n): sums over windows (low, high), each from two rows per group."""
    ends = F.array(
        F.struct(F.col("high").alias("day"), F.lit(1).alias("sign")),
        F.struct(F.date_sub("low", 1).alias("day"), F.lit(-1).alias("sign")),
    )
    asked = windows.select(*keys, "is_current", F.inline(ends))
    asked = asked.withColumn("date", _upto(prefix, F.col("day")))
    return asked.join(prefix, "date").groupBy(*keys, "is_current", *by).agg(F.sum(F.col("sign") * F.col("cum")).alias("n"))


def period_sums(
    prefix: DataFrame, as_of: Column | str, by: Sequence[str] = ("label",), codes: Iterable[str] = PERIODS.values()
) -> DataFrame:
    """Sum of ``count`` per group in every period and in the one it is compared with, from ``cumulative``."""
    windows = _windows(prefix.sparkSession, as_of, codes)
    sums = _differences(prefix, windows, ["code", "compare"], by)
    return sums.groupBy("code", "compare", *by).agg(
        F.sum(F.when(F.col("is_current"), F.col("n"))).alias("current"),
        F.sum(F.when(~F.col("is_current"), F.col("n"))).alias("comparison"),
    )


def growth_sums(
    prefix: DataFrame, first: Day, last: Day, by: Sequence[str] = ("label",), shifts: Sequence[int] = (7, 30, 90)
) -> DataFrame:
    """Per group: badges of a window, and badges and growth for each shift in days, from ``cumulative``."""
    names = {0: "badges"} | {days: f"badges_{days}" for days in shifts}
    rows = [
        F.struct(
            F.lit(days).alias("shift"),
            F.lit(True).alias("is_current"),
            F.date_sub(as_date(first), days).alias("low"),
            F.date_sub(as_date(last), days).alias("high"),
        )
        for days in names
    ]
    windows = prefix.sparkSession.range(1).select(F.inline(F.array(*rows)))
    sums = _differences(prefix, windows, ["shift"], by)
    wide = sums.groupBy(*by).agg(*[F.sum(F.when(F.col("shift") == days, F.col("n"))).alias(name) for days, name in names.items()])
    figures = [F.col("badges")]
    for days in shifts:
        figures += [F.col(f"badges_{days}"), growth("badges", f"badges_{days}").alias(f"growth_{days}")]
    return wide.select(*by, *figures)
