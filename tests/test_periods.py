import calendar
import datetime as dt

import pytest
from helpers import plan, tuples
from hypothesis import given
from hypothesis import settings as effort
from hypothesis import strategies as st
from pyspark.sql import functions as F

from badgewright.fixed import PERIODS
from badgewright.functions.periods import period
from badgewright.operators.filters import date_range
from badgewright.operators.periods import period_rollup, period_table

D = dt.date

# Bounds worked out by hand.
BY_HAND = [
    ("2019-03-31", "m", "Previous", D(2019, 3, 1), D(2019, 3, 31), D(2019, 2, 1), D(2019, 2, 28)),
    ("2019-03-31", "qp", "Previous", D(2018, 10, 1), D(2018, 12, 31), D(2018, 7, 1), D(2018, 9, 30)),
    ("2020-02-29", "mp", "Year ago", D(2020, 1, 1), D(2020, 1, 31), D(2019, 1, 1), D(2019, 1, 31)),
    ("2020-02-29", "7", "Year ago", D(2020, 2, 22), D(2020, 2, 28), D(2019, 2, 22), D(2019, 2, 28)),
    ("2024-01-01", "y", "None", D(2024, 1, 1), D(2024, 12, 31), D(2023, 1, 1), D(2023, 12, 31)),
    ("2024-01-01", "w", "Previous", D(2024, 1, 1), D(2024, 1, 7), D(2023, 12, 25), D(2023, 12, 31)),
    ("2024-01-01", "90", "Previous", D(2023, 10, 3), D(2023, 12, 31), D(2023, 7, 5), D(2023, 10, 2)),
    # On a Sunday "this week" starts the next day.
    ("2024-12-29", "w", "Previous", D(2024, 12, 30), D(2025, 1, 5), D(2024, 12, 23), D(2024, 12, 29)),
    ("2024-12-29", "wp", "Year ago", D(2024, 12, 23), D(2024, 12, 29), D(2023, 12, 23), D(2023, 12, 29)),
    ("2021-03-01", "1", "Year ago", D(2021, 2, 28), D(2021, 2, 28), D(2020, 2, 28), D(2020, 2, 28)),
]


@pytest.mark.parametrize("case", BY_HAND, ids=lambda c: "-".join(c[:3]))
def test_bounds_by_hand(spark, case):
    as_of, code, compare, *bounds = case
    assert tuples(spark.range(1).select(*period(code, F.lit(as_of).cast("date"), compare))) == [tuple(bounds)]


def shifted(day, months):
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return D(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def expected(day, code, before):
    if code[0] in "mqy":
        months = {"m": 1, "q": 3, "y": 12}[code[0]]
        first_month = {"m": day.month, "q": 3 * ((day.month - 1) // 3) + 1, "y": 1}[code[0]]
        start = shifted(D(day.year, first_month, 1), -months if code.endswith("p") else 0)
        back = shifted(start, -months if before else -12)
        one = dt.timedelta(1)
        return start, shifted(start, months) - one, back, shifted(back, months) - one
    if code[0] == "w":
        n = 7
        start = day + dt.timedelta(1 - day.isoweekday() % 7 - (7 if code == "wp" else 0))
        end = start + dt.timedelta(6)
    else:
        n = int(code)
        start, end = day - dt.timedelta(n), day - dt.timedelta(1)
    back = start - dt.timedelta(n) if before else shifted(start, -12)
    return start, end, back, back + dt.timedelta(n - 1)


@effort(max_examples=5, deadline=None)
@given(days=st.lists(st.dates(D(1990, 1, 1), D(2060, 12, 31)), min_size=20, max_size=40, unique=True))
def test_table_of_any_days(spark, days):
    table = period_table(spark.createDataFrame([(d,) for d in days], "as_of date"))
    got = {(r.as_of, r.code, r.compare): (r.start, r.end, r.cmp_start, r.cmp_end) for r in table.collect()}
    assert got == {
        (d, code, mode): expected(d, code, mode == "Previous")
        for d in days
        for code in PERIODS.values()
        for mode in ("Previous", "Year ago")
    }


def test_unknown_code(spark):
    with pytest.raises(ValueError, match="Custom"):
        period("Custom")


def test_bounds_of_today_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.sql("SELECT current_date() - 3 AS date, 1L AS count").write.parquet(path)
    bounds = period("7")
    chosen = date_range(spark.read.parquet(path), bounds.start, bounds.end)
    assert "GreaterThanOrEqual(date," in plan(chosen)
    assert chosen.count() == 1


def test_rollup_sums_current_and_comparison(spark):
    rows = [(D(2024, 1, 30), 5), (D(2024, 1, 29), 2), (D(2024, 1, 20), 3), (D(2023, 1, 30), 7), (None, 9)]
    fact = spark.createDataFrame(rows, "date date, count long")
    got = {(r.code, r.compare): (r.current, r.comparison) for r in period_rollup(fact, "2024-01-31").collect()}
    assert len(got) == 24
    assert got["7", "Previous"] == (7, 3)
    assert got["7", "Year ago"] == (7, 7)
    assert got["m", "Year ago"] == (10, 7)
    assert got["yp", "Previous"] == (7, 0)
