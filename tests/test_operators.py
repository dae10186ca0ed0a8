import pytest
from helpers import column, plan, tuples
from pyspark.sql import functions as F

from badgewright.operators import aggregates
from badgewright.operators.aggregates import (
    dense_distribution,
    grand_totals,
    in_order,
    measures,
    pivot_sum,
    running_shares,
    with_count,
)
from badgewright.operators.display import page, paired_columns
from badgewright.operators.filters import dim_filter, label_in


@pytest.fixture
def people(spark):
    rows = [(1, "18-24", "Alberta", 3), (2, "25-34", "Ontario", 3), (3, None, "Alberta", None), (4, "18-24", None, 4)]
    return spark.createDataFrame(rows, "id int, age string, province string, level int")


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        (None, [1, 2, 3, 4]),
        ({}, [1, 2, 3, 4]),
        ({"age": "All Ages", "level": "All Levels"}, [1, 2, 3, 4]),
        ({"age": "18-24"}, [1, 4]),
        ({"province": "Alberta"}, [1, 3]),
        ({"age": "18-24", "province": "Alberta"}, [1]),
        (["age", "18-24", "province", "All Provinces"], [1, 4]),
        (["age", "18-24", "age", "25-34"], []),
        ({"level": "3"}, [1, 2]),
        ({"level": "high"}, []),
        ({"level": 4}, [4]),
    ],
)
def test_dimension_filters(people, filters, ids):
    assert sorted(column(dim_filter(people, filters), "id")) == ids


def test_unknown_filter_column(people):
    with pytest.raises(ValueError, match="answerValue"):
        dim_filter(people, {"answerValue": "x"})


def test_label_list_drops_null(spark):
    df = spark.sql("SELECT explode(array('a', 'b', NULL)) AS label")
    assert column(label_in(df, ["a", "z"]), "label") == ["a"]


def seen(spark, *pairs):
    return spark.createDataFrame(pairs, "badges long, users long")


def test_distribution_fills_every_count(spark):
    got = dense_distribution(seen(spark, (1, 2), (4, 1))).orderBy("badges")
    assert tuples(got) == [(0, 0, 0, 3), (1, 2, 2, 3), (2, 0, 2, 3), (3, 0, 2, 3), (4, 1, 3, 3)]


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_distribution_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(aggregates, "FILL_BLOCK", block)
    got = tuples(dense_distribution(seen(spark, (2, 5), (9, 1), (10, 4))).orderBy("badges"))
    assert [r[0] for r in got] == list(range(11))
    assert [r[1] for r in got] == [0, 0, 5, 0, 0, 0, 0, 0, 0, 1, 4]
    assert [r[2] for r in got] == [0, 0, 5, 5, 5, 5, 5, 5, 5, 6, 10]


def test_distribution_with_a_customer_far_above_the_rest(spark):
    got = dense_distribution(seen(spark, (1, 3), (1_000_000, 1)))
    assert got.agg(F.count("*"), F.sum("users"), F.max("cum_users"), F.sum("badges")).collect()[0] == (
        1_000_001,
        4,
        4,
        500_000_500_000,
    )


def test_distribution_of_nothing(spark):
    empty = spark.createDataFrame([], "badges long, users long")
    assert dense_distribution(empty).count() == 0


def test_running_shares(spark):
    df = spark.createDataFrame([(2, 1), (1, 3), (None, 4)], "level int, n long")
    got = running_shares(df, "level").orderBy(F.col("level").asc_nulls_last())
    assert tuples(got) == [(1, 3, 37.5, 37.5), (2, 1, 12.5, 50.0), (None, 4, 50.0, 100.0)]


def test_pivot_keeps_absent_pairs_null_and_names_the_null_column(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", None, 1), ("b", "y", 5)], "label string, c string, n long")
    got = pivot_sum(df, "label", "c", ["x", "y", "<NA>"]).orderBy("label")
    assert got.columns == ["label", "x", "y", "<NA>", "<other>"]
    assert tuples(got) == [("a", 2, None, 1, None), ("b", None, 5, None, None)]


def test_pivot_keeps_values_that_are_not_listed(spark):
    rows = [("a", "x", 2), ("a", "z", 3), ("a", "w", 4), ("b", "z", 1), ("b", None, 7)]
    df = spark.createDataFrame(rows, "label string, c string, n long")
    got = pivot_sum(df, "label", "c", ["x", "y"]).orderBy("label")
    assert got.columns == ["label", "x", "y", "<NA>", "<other>"]
    assert tuples(got) == [("a", 2, None, None, 7), ("b", None, None, 7, 1)]


def test_measures_count_a_customer_once_per_group(spark):
    rows = [(1, "a", 2), (1, "a", 3), (2, "a", 1), (1, "b", 1)]
    df = spark.createDataFrame(rows, "customer_id int, label string, count long")
    assert sorted(tuples(measures(df, ["label"]))) == [("a", 6, 2), ("b", 1, 1)]
    assert sorted(tuples(measures(df, ["label"], approx=True))) == [("a", 6, 2), ("b", 1, 1)]
    assert tuples(grand_totals(df)) == [(7, 2)]
    # The distinct count is shuffled by group and customer first, so one big group is no hot spot.
    assert "hashpartitioning(label" in plan(measures(df, ["label"])).replace(" ", "")
    assert plan(measures(df, ["label"])).count("Exchange hashpartitioning") == 2


def test_order_of_a_label_list(spark):
    df = spark.sql("SELECT explode(array('a', 'b', 'c')) AS label")
    assert tuples(in_order(df, ["c", "missing", "a", "b"])) == [("c", 1), ("a", 3), ("b", 4)]


def test_missing_measure_counts_rows(spark):
    assert column(with_count(spark.range(2)), "count") == [1, 1]
    with_measure = spark.sql("SELECT 5 AS count")
    assert with_count(with_measure) is with_measure


def test_paired_columns(spark):
    df = spark.sql("SELECT 'a' AS label, 12.3D AS share")
    got = paired_columns(df, percents=["share"])
    assert got.columns == ["label_rank", "label", "share_rank", "share"]
    assert tuples(got) == [("a", "a", "12.30%", 12.3)]


def test_pages(spark):
    df = spark.range(40).withColumn("x", F.lit(1))
    assert column(page(df, ["id"], number=2, rows=15), "id") == list(range(15, 30))
    assert column(page(df, ["id"], number=3), "id") == list(range(30, 40))
    assert column(page(df, [F.desc("id")], rows=2), "id") == [39, 38]
    assert "TakeOrderedAndProject" in plan(page(df, ["id"], 2, 5))
