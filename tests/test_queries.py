"""Every registered query against its SQL, and what must hold for every plan."""

from pathlib import Path

import oracle
import pytest
from helpers import plan

import __spark_entry__ as contract
from badgewright.catalog.oracle import ORACLE as SQL
from badgewright.catalog.queries import QUERIES

ROOT = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(ROOT)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


# Their filters may match none of the 15 customers of the smallest data.
MAY_BE_EMPTY = {"dim_filter", "badge_summary_filtered", "rewards_pivot", "rewards_pivot_filtered", "new_users"}


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    found, ours, theirs = oracle.compare(QUERIES[name](spark, ROOT), duck, SQL[name])
    assert found > 0 or name in MAY_BE_EMPTY
    assert (ours, theirs) == ([], [])


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_with_salted_joins(spark, duck, no_broadcast, name):
    _, ours, theirs = oracle.compare(QUERIES[name](spark, ROOT), duck, SQL[name])
    assert (ours, theirs) == ([], [])


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_without_broadcasts(spark, duck, settings, name):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    df = QUERIES[name](spark, ROOT)
    assert "_salt" not in plan(df)
    _, ours, theirs = oracle.compare(df, duck, SQL[name])
    assert (ours, theirs) == ([], [])


SALTED = ["badge_summary", "badge_histogram", "milestone_top", "badge_cube_answers", "rewards_fact", "rewards_pivot"]


@pytest.mark.parametrize("name", SALTED)
def test_large_joins_are_salted_where_skew_is_not_handled(spark, no_broadcast, name):
    assert "_salt" in plan(QUERIES[name](spark, ROOT))


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_no_nested_loops_and_no_python_in_plans(spark, settings, name, threshold):
    settings(spark__sql__autoBroadcastJoinThreshold=threshold)
    text = plan(QUERIES[name](spark, ROOT))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert operator not in text


def test_date_and_label_filters_reach_the_scan(spark):
    text = plan(QUERIES["badge_summary"](spark, ROOT))
    assert "GreaterThanOrEqual(ts,2024-01-24" in text and "In(event_type" in text or "In(event_..." in text


def test_entry(spark):
    assert contract.entry(spark).columns[0] == "label"
