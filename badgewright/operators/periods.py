"""All relative periods at once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from badgewright.fixed import PERIODS
from badgewright.functions.periods import Period, period
from badgewright.operators.filters import as_date, date_range

COMPARE_MODES = ("Previous", "Year ago")


def every_period(day: Column, codes: Iterable[str] = PERIODS.values()) -> dict[tuple[str, str], Period]:
    """Bounds of every code in both compare modes, for one reference day."""
    return {(code, mode): period(code, day, mode) for code in codes for mode in COMPARE_MODES}


def as_rows(periods: dict[tuple[str, str], Period]) -> Column:
    """Make one row per period: code, compare mode and the four bounds."""
    rows = [
        F.struct(
            F.lit(code).alias("code"),
            F.lit(mode).alias("compare"),
            *[bound.alias(name) for name, bound in bounds._asdict().items()],
        )
        for (code, mode), bounds in periods.items()
    ]
    return F.inline(F.array(*rows))


def period_table(days: DataFrame, as_of: str = "as_of", codes: Sequence[str] | None = None) -> DataFrame:
    """For every reference day, the bounds of every period code in both compare modes."""
    return days.select(as_of, as_rows(every_period(F.col(as_of), codes or PERIODS.values())))


def period_rollup(fact: DataFrame, as_of: Column | str) -> DataFrame:
    """Sum of ``count`` in every period and in the one it is compared with.

    The fact is cut to the days any period covers and summed by day before it
    meets the periods. Each period is spelt out as its days (24 periods of at
    most 366 days, twice), which makes the range condition an equality between
    two small relations.
    """
    periods = every_period(as_date(as_of))
    first = F.least(*[day for p in periods.values() for day in (p.start, p.cmp_start)])
    last = F.greatest(*[day for p in periods.values() for day in (p.end, p.cmp_end)])
    daily = date_range(fact, first, last).groupBy("date").agg(F.sum("count").alias("n"))

    windows = F.array(
        F.struct(F.lit(True).alias("is_current"), F.col("start").alias("low"), F.col("end").alias("high")),
        F.struct(F.lit(False).alias("is_current"), F.col("cmp_start").alias("low"), F.col("cmp_end").alias("high")),
    )
    table = fact.sparkSession.range(1).select(as_rows(periods))
    days = table.select("code", "compare", F.inline(windows)).select(
        "code", "compare", "is_current", F.explode(F.sequence("low", "high")).alias("date")
    )
    matched = days.join(daily, "date", "left")
    return matched.groupBy("code", "compare").agg(
        F.coalesce(F.sum(F.when(F.col("is_current"), F.col("n"))), F.lit(0).cast("bigint")).alias("current"),
        F.coalesce(F.sum(F.when(~F.col("is_current"), F.col("n"))), F.lit(0).cast("bigint")).alias("comparison"),
    )
