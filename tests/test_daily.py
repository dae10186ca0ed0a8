"""Stored sketches and running sums against counts and sums over the fact itself."""

import datetime

import pytest
from helpers import plan, tuples
from pyspark.sql import functions as F

from badgewright.fixed import PERIODS
from badgewright.operators.filters import date_range
from badgewright.operators.periods import period_rollup
from badgewright.plans import daily, kpis
from badgewright.sources.files import materialised

AS_OF = "2024-02-10"


def fact(spark, n=20_000, customers=900):
    """Half of the rows are one label; a label may be NULL; two weeks have no rows."""
    label = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 31 == 0, None).otherwise(F.concat(F.lit("l"), F.col("id") % 5))
    date = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.hash("id"), 400).cast("int"))
    df = spark.range(n).select(
        F.when(F.col("id") % 97 != 0, F.pmod(F.xxhash64("id"), customers)).alias("customer_id"),
        label.alias("label"),
        date.alias("date"),
        (F.col("id") % 3).alias("count"),
    )
    return df.where("date NOT BETWEEN '2023-06-01' AND '2023-06-14'")


def test_few_customers_are_counted_exactly(spark):
    df = fact(spark)
    sketches = materialised(daily.daily_sketches(df), "sketches")
    for first, last in (("2023-01-01", "2024-02-05"), ("2023-03-03", "2023-03-03"), ("2023-05-20", "2023-06-20")):
        expected = date_range(df, first, last).groupBy("label").agg(F.sum("count"), F.count_distinct("customer_id"))
        found = daily.sketched_measures(sketches, first, last)
        assert sorted(tuples(found), key=str) == sorted(tuples(expected), key=str)
        whole = daily.sketched_measures(sketches, first, last, by=())
        assert tuples(whole) == tuples(date_range(df, first, last).agg(F.sum("count"), F.count_distinct("customer_id")))


@pytest.mark.parametrize("log_entries", [8, 11])
def test_many_customers_lie_within_the_stated_error(spark, log_entries):
    df = fact(spark, 60_000, 30_000)
    sketches = materialised(daily.daily_sketches(df, log_entries=log_entries), "sketches")
    error = 4 * daily.standard_error(log_entries)
    for first, last in (("2023-01-01", "2024-02-05"), ("2023-02-01", "2023-05-01"), ("2023-07-01", "2023-07-31")):
        exact = dict(tuples(date_range(df, first, last).groupBy("label").agg(F.count_distinct("customer_id"))))
        found = daily.sketched_measures(sketches, first, last, log_entries=log_entries)
        for label, _, estimate in tuples(found):
            assert abs(estimate - exact[label]) <= max(1, error * exact[label])


def test_every_period_from_the_sketches(spark):
    df = fact(spark)
    sketches = materialised(daily.daily_sketches(df), "sketches")
    found = {(r["code"], r["compare"]): (r["current"], r["comparison"]) for r in daily.period_customers(sketches, AS_OF).collect()}
    from badgewright.functions.periods import period

    day = F.lit(AS_OF).cast("date")
    for (code, mode), counts in found.items():
        p = period(code, day, mode)
        exact = df.agg(
            F.count_distinct(F.when(F.col("date").between(p.start, p.end), F.col("customer_id"))),
            F.count_distinct(F.when(F.col("date").between(p.cmp_start, p.cmp_end), F.col("customer_id"))),
        )
        assert counts == tuples(exact)[0]
    assert len(found) == 2 * len(PERIODS)


@pytest.mark.parametrize("window", [("2023-04-01", "2023-04-20"), ("2023-06-03", "2023-06-10"), ("2023-06-10", "2023-06-20"), ("1999-01-01", "1999-02-01")])
def test_tiles_from_the_sketches(spark, window):
    df = fact(spark).where("customer_id IS NOT NULL")
    sketches = materialised(daily.daily_sketches(df), "sketches")
    assert tuples(daily.sketched_tiles(sketches, *window)) == tuples(kpis.kpi_tiles(df, *window))


def test_a_window_reads_the_sketches_only(spark):
    sketches = materialised(daily.daily_sketches(fact(spark)), "sketches")
    for df in (daily.sketched_measures(sketches, "2023-01-01", "2023-03-01"), daily.sketched_tiles(sketches, "2023-03-01", "2023-03-10")):
        text = plan(df)
        assert text.count("FileScan") == 1 and "Range" not in text and "ReadSchema: struct<date:date" in text


def test_empty_fact(spark):
    df = fact(spark, 0)
    sketches = materialised(daily.daily_sketches(df), "sketches")
    assert tuples(daily.sketched_measures(sketches, "2023-01-01", "2024-01-01")) == []
    assert tuples(daily.sketched_tiles(sketches, "2023-01-01", "2023-01-05")) == [(0, 0, None, 0, None, None)]
    prefix = materialised(daily.cumulative(df), "cumulative")
    assert tuples(prefix) == [] and tuples(daily.period_sums(prefix, AS_OF)) == []


def test_period_sums_equal_the_scan(spark):
    df = fact(spark)
    prefix = materialised(daily.cumulative(df), "cumulative")
    found = daily.period_sums(prefix, AS_OF).groupBy("code", "compare").agg(F.sum("current"), F.sum("comparison"))
    assert sorted(tuples(found)) == sorted(tuples(period_rollup(df, AS_OF)))
    for label in ("hot", "l1", None):
        own = daily.period_sums(prefix, AS_OF).where(F.col("label").eqNullSafe(F.lit(label)))
        scan = period_rollup(df.where(F.col("label").eqNullSafe(F.lit(label))), AS_OF)
        assert sorted(tuples(own.drop("label"))) == sorted(tuples(scan))


def test_growth_equals_the_scan(spark):
    df = fact(spark)
    prefix = materialised(daily.cumulative(df, by=["label"]), "cumulative")
    found = {r[0]: tuple(r)[1:] for r in daily.growth_sums(prefix, "2023-04-05", "2023-04-25").collect()}
    for label in found:
        own = df.where(F.col("label").eqNullSafe(F.lit(label)))
        assert found[label] == tuples(kpis.kpi_growth(own, "2023-04-05", "2023-04-25"))[0]


def test_a_row_for_every_day(spark):
    rows = tuples(daily.cumulative(fact(spark)).where("label = 'hot'").select("date", "cum").orderBy("date"))
    days = [r[0] for r in rows]
    assert days == [days[0] + datetime.timedelta(k) for k in range(len(days))] and rows[0][1] == 0
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
