import datetime as dt

import pytest
from helpers import column, tuples

from badgewright.operators.aggregates import grand_totals
from badgewright.plans import kpis, reports

D = dt.date
SCHEMA = "customer_id int, label string, date date, count long, gender string, user_selected_level int"


@pytest.fixture
def fact(spark):
    rows = [
        (1, "b", D(2024, 1, 10), 2, "F", 0),
        (1, "a", D(2024, 1, 11), 1, "F", 0),
        (2, "b", D(2024, 1, 12), 3, "M", 1),
        (3, "b", D(2024, 1, 3), 4, "F", 2),
        (3, "a", D(2024, 1, 16), 1, "F", 2),
        (4, "c", D(2024, 1, 10), 5, "M", None),
        (5, "a", None, 4, "M", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


WEEK = ("2024-01-10", "2024-01-16")


def test_summary_follows_the_label_list_and_the_whole_fact(fact):
    got = tuples(reports.badge_summary(fact, ["b", "z", "a"], *WEEK))
    assert got == [("b", 5, 2, 25.0, 40.0, 2.5, 1), ("a", 2, 2, 10.0, 40.0, 1.0, 3)]


def test_summary_keeps_the_unfiltered_denominators(fact):
    got = reports.badge_summary(fact, ["a", "b"], *WEEK, filters={"gender": "F", "user_selected_level": "All Levels"})
    assert tuples(got, "label", "total", "distribution", "penetration") == [("a", 2, 10.0, 40.0), ("b", 2, 10.0, 20.0)]


def test_summary_with_kept_totals(spark, fact):
    totals = spark.sql("SELECT 100L AS total_awards, 10L AS unique_users")
    got = reports.badge_summary(fact, ["b"], *WEEK, totals=totals)
    assert tuples(got, "distribution", "penetration") == [(5.0, 20.0)]


def test_subtotal_counts_a_customer_once(fact):
    got = tuples(reports.badge_subtotal(fact, ["a", "b"], *WEEK))
    assert got == [("Total", 7, 3, 35.0, 60.0, 2.33)]
    assert reports.badge_subtotal(fact, ["none"], *WEEK).count() == 0


def test_rollup_equals_summary_and_subtotal(fact):
    got = set(tuples(reports.badge_rollup(fact, ["a", "b"], *WEEK)))
    assert got == {("a", 2, 2), ("b", 5, 2), ("Total", 7, 3)}
    assert reports.badge_rollup(fact, ["none"], *WEEK).count() == 0


def test_delta_against_the_week_before(fact):
    got = sorted(tuples(reports.badge_delta(fact, ["a", "b"], *WEEK)))
    assert got == [("a", 2, 0, 2, None), ("b", 5, 4, 1, 25.0)]


def test_histogram_counts_rows(spark):
    rows = [(1, D(2024, 1, 1)), (2, D(2024, 1, 1))] + [(3, D(2024, 1, d)) for d in (1, 2, 3, 4)]
    fact = spark.createDataFrame(rows, "customer_id int, date date")
    got = reports.badge_histogram(fact, "2024-01-01", "2024-01-31")
    assert tuples(got, "badges", "users") == [(0, 0), (1, 2), (2, 0), (3, 0), (4, 1)]
    last = got.collect()[-1]
    assert last.cum_distribution == last.cum_penetration == 100.0
    shown = reports.badge_histogram_display(got)
    assert column(shown, "cum_distribution_rank")[-1] == "100.00%"
    assert reports.badge_histogram(fact, "2030-01-01", "2030-01-31").count() == 0


def test_levels_share_rows(fact):
    got = tuples(reports.activity_levels(fact, *WEEK))
    assert got == [(0, 2, 40.0, 40.0), (1, 1, 20.0, 60.0), (2, 1, 20.0, 80.0), (None, 1, 20.0, 100.0)]


def test_daily_series(fact):
    got = tuples(reports.daily_series(fact, *WEEK))
    assert got == [(D(2024, 1, 10), 7), (D(2024, 1, 11), 1), (D(2024, 1, 12), 3), (D(2024, 1, 16), 1)]
    rows = reports.daily_series(fact.drop("count"), *WEEK)
    assert column(rows, "n") == [2, 1, 1, 1]


def test_filter_choices(spark, fact):
    more = spark.sql("SELECT explode(array('L2', 'L1', NULL)) AS max_level")
    got = tuples(reports.filter_choices((fact, ["gender", "user_selected_level"]), (more, ["max_level"])))
    assert got == [
        ("gender", "F"),
        ("gender", "M"),
        ("hour", "Afternoon"),
        ("hour", "Evening"),
        ("hour", "Morning"),
        ("hour", "Night"),
        ("max_level", "L1"),
        ("max_level", "L2"),
        ("user_selected_level", "0"),
        ("user_selected_level", "1"),
        ("user_selected_level", "2"),
    ]


def test_invariants(fact):
    labels = ["a", "b", "c"]
    summary = reports.badge_summary(fact, labels, *WEEK).collect()
    subtotal = reports.badge_subtotal(fact, labels, *WEEK).collect()[0]
    histogram = reports.badge_histogram(fact, *WEEK).collect()
    in_week = reports.in_window(fact, *WEEK)
    assert subtotal.total == sum(r.total for r in summary)
    assert subtotal.unique_users <= sum(r.unique_users for r in summary)
    assert sum(r.users for r in histogram) == grand_totals(in_week).collect()[0].unique_users


@pytest.fixture
def visits(spark):
    """Window 11 to 17 January; the window before it is 4 to 10 January."""
    rows = [
        ("both", D(2024, 1, 4), 1),
        ("both", D(2024, 1, 17), 1),
        ("now", D(2024, 1, 11), 4),
        ("before", D(2024, 1, 10), 1),
        ("edge", D(2024, 1, 10), 1),
        ("edge", D(2024, 1, 11), 1),
        ("long ago", D(2023, 12, 15), 2),
        ("outside", D(2024, 1, 18), 50),
    ]
    return spark.createDataFrame(rows, "customer_id string, date date, count long")


NOW = ("2024-01-11", "2024-01-17")


def test_new_customers(visits):
    assert column(kpis.new_customers(visits, *NOW), "customer_id") == ["now"]


def test_tiles(visits):
    tiles = kpis.kpi_tiles(visits, *NOW)
    assert tuples(tiles) == [(6, 3, 2.0, 1, 1.0, 2.0)]
    assert tuples(kpis.kpi_tiles_display(tiles)) == [("6", "3", "2.00", "1", "100.00%", "200.00%")]


def test_tiles_without_a_base(visits):
    tiles = kpis.kpi_tiles(visits, *NOW, filters={"customer_id": "now"})
    assert tuples(tiles) == [(4, 1, 4.0, 1, None, None)]
    assert tuples(kpis.kpi_tiles_display(tiles), "growth_7") == [("N/A",)]


def test_tiles_of_an_empty_window(visits):
    assert tuples(kpis.kpi_tiles(visits, "2030-01-01", "2030-01-07")) == [(0, 0, None, 0, None, None)]


def test_growth(visits):
    got = kpis.kpi_growth(visits, *NOW, shifts=(7, 30))
    assert tuples(got) == [(6, 3, 1.0, 2, 2.0)]
