"""The reports. Each takes a fact with ``customer_id``, ``label``, ``date``, ``count``
and dimensions, and returns a lazy DataFrame.

``first`` and ``last`` are days (text, date or a constant column such as a bound
of ``functions.periods.period``). ``filters`` are dimension filters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from badgewright.fixed import BADGE_REPORTS, DAY_PARTS
from badgewright.functions.numbers import percent_diff, percent_of
from badgewright.functions.periods import period
from badgewright.operators.aggregates import (
    customers_per_count,
    dense_distribution,
    grand_totals,
    in_order,
    measures,
    pivot_sum,
    running_shares,
    with_count,
    with_shares,
)
from badgewright.operators.display import paired_columns
from badgewright.operators.filters import Day, date_range, dim_filter, in_days, label_in
from badgewright.sources.lookups import literal_rows

Filters = Mapping[str, str] | Sequence[str] | None


def in_window(fact: DataFrame, first: Day, last: Day, filters: Filters = None) -> DataFrame:
    return dim_filter(date_range(fact, first, last), filters)


def for_period(
    report: Callable[..., DataFrame],
    fact: DataFrame,
    code: str,
    labels: str | Sequence[str] | None = None,
    as_of: Column | None = None,
    **options,
) -> DataFrame:
    """Any windowed report for a period code (``functions.periods``), such as the last 90 days or this quarter.

    ``labels`` is a list, the name of one in ``BADGE_REPORTS``, or left out for reports that take none.
    """
    window = period(code, as_of)
    given = () if labels is None else (BADGE_REPORTS[labels] if isinstance(labels, str) else labels,)
    return report(fact, *given, first=window.start, last=window.end, **options)


def badge_summary(
    fact: DataFrame,
    labels: Sequence[str],
    first: Day,
    last: Day,
    filters: Filters = None,
    totals: DataFrame | None = None,
    approx: bool = False,
) -> DataFrame:
    """Badges and customers per label, with shares of the whole fact, in label order.

    ``totals`` (see ``grand_totals``) can be given to use ones kept from before;
    otherwise they are computed from the unfiltered fact.
    """
    totals = grand_totals(fact, approx) if totals is None else totals
    chosen = label_in(in_window(fact, first, last, filters), labels)
    return in_order(with_shares(measures(chosen, ["label"], approx), totals), labels)


def badge_summary_display(summary: DataFrame) -> DataFrame:
    return paired_columns(summary, percents=("distribution", "penetration"))


def badge_subtotal(
    fact: DataFrame,
    labels: Sequence[str],
    first: Day,
    last: Day,
    filters: Filters = None,
    totals: DataFrame | None = None,
    approx: bool = False,
) -> DataFrame:
    """The summary of all labels together; a customer with several labels counts once."""
    totals = grand_totals(fact, approx) if totals is None else totals
    chosen = label_in(in_window(fact, first, last, filters), labels)
    return with_shares(measures(chosen, [F.lit("Total").alias("label")], approx), totals)


def badge_rollup(fact: DataFrame, labels: Sequence[str], first: Day, last: Day, filters: Filters = None) -> DataFrame:
    """Labels and their total in one pass.

    Rows are first summed per label and customer; only that is expanded for the rollup.
    """
    chosen = label_in(in_window(fact, first, last, filters), labels)
    per_customer = chosen.groupBy("label", "customer_id").agg(F.sum("count").alias("n"))
    rolled = per_customer.rollup("label").agg(
        F.grouping("label").alias("is_total"),
        F.sum("n").alias("total"),
        F.count_distinct("customer_id").alias("unique_users"),
    )
    label = F.when(F.col("is_total") == 1, "Total").otherwise(F.col("label"))
    return rolled.select(label.alias("label"), "total", "unique_users")


def badge_delta(
    fact: DataFrame,
    labels: Sequence[str],
    first: Day,
    last: Day,
    shift: int = 7,
    filters: Filters = None,
) -> DataFrame:
    """Badges per label now and ``shift`` days before, in one scan of both windows."""
    now, before = in_days("date", first, last), in_days("date", first, last, shift)
    chosen = label_in(dim_filter(fact.where(now | before), filters), labels)

    def total(window: Column) -> Column:
        return F.sum(F.when(window, F.col("count")).otherwise(F.lit(0)))

    sums = chosen.groupBy("label").agg(total(now).alias("total"), total(before).alias("total_prev"))
    return sums.withColumns(
        {
            "delta": F.col("total") - F.col("total_prev"),
            "pct": percent_diff("total", "total_prev"),
        }
    )


def badge_histogram(fact: DataFrame, first: Day, last: Day, filters: Filters = None) -> DataFrame:
    """How many customers have how many badges (rows), from 0 to the most, cumulated.

    Penetration is measured against the customers of the window, which makes it
    equal to distribution.
    """
    dense = dense_distribution(customers_per_count(in_window(fact, first, last, filters)))
    share, cum_share = percent_of("users", "all_users"), percent_of("cum_users", "all_users")
    return dense.select(
        "badges",
        "users",
        share.alias("distribution"),
        share.alias("penetration"),
        cum_share.alias("cum_distribution"),
        cum_share.alias("cum_penetration"),
    ).orderBy("badges")


def badge_histogram_display(histogram: DataFrame) -> DataFrame:
    return paired_columns(
        histogram, percents=("distribution", "penetration", "cum_distribution", "cum_penetration")
    )


def activity_levels(fact: DataFrame, first: Day, last: Day, level: str = "user_selected_level") -> DataFrame:
    """Rows per onboarding level, their share and cumulative share. Takes no dimension filters."""
    per_level = date_range(fact, first, last).groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return running_shares(per_level, "level").orderBy(F.col("level").asc_nulls_last())


def daily_series(fact: DataFrame, first: Day, last: Day, filters: Filters = None) -> DataFrame:
    chosen = in_window(with_count(fact), first, last, filters)
    return chosen.groupBy("date").agg(F.round(F.sum("count"), 2).alias("n")).orderBy("date")


def app_by_os(first_opens: DataFrame) -> DataFrame:
    return first_opens.groupBy("operating_system").agg(F.sum("first_open").alias("first_open"))


def rewards_counts(
    fact: DataFrame, labels: Sequence[str] | None, first: Day, last: Day, filters: Filters = None
) -> DataFrame:
    """Ballots per label and reward cycle, most first; no label list means every label."""
    chosen = in_window(with_count(fact), first, last, filters)
    chosen = chosen if labels is None else label_in(chosen, labels)
    counts = chosen.groupBy("label", "cycle_type").agg(F.sum("count").alias("n"))
    return counts.orderBy(F.desc("n"), "label", "cycle_type")


def rewards_pivot(
    fact: DataFrame,
    labels: Sequence[str],
    cycles: Sequence[str],
    first: Day,
    last: Day,
    filters: Filters = None,
) -> DataFrame:
    """Ballots per label, one column per reward cycle; ``<NA>`` holds ballots of no cycle."""
    chosen = label_in(in_window(with_count(fact), first, last, filters), labels)
    return pivot_sum(chosen, "label", "cycle_type", cycles, "count").orderBy("label")


def dimension_values(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The distinct values of several columns, as (dimension, value).

    Only the distinct combinations are made tall, not every row of the fact.
    """
    pairs = ", ".join(f"'{d}', cast(`{d}` as string)" for d in dimensions)
    combinations = df.select(*dimensions).distinct()
    tall = combinations.select(F.expr(f"stack({len(dimensions)}, {pairs}) as (dimension, value)"))
    return tall.where(F.col("value").isNotNull()).distinct()


def filter_choices(*sources: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """The values to choose from, per dimension and sorted.

    Each source is a relation and the dimensions it gives. Day parts are a fixed list.
    """
    spark = sources[0][0].sparkSession
    choices = literal_rows(spark, [("hour", part) for part in DAY_PARTS], ["dimension", "value"])
    for df, dimensions in sources:
        choices = choices.unionByName(dimension_values(df, dimensions))
    return choices.orderBy("dimension", "value")
