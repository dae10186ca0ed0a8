"""The bitmap index against distinct counts over the fact."""

import itertools

import pytest
from helpers import plan, tuples
from pyspark.sql import functions as F

from badgewright.plans import bitmaps
from badgewright.sources.files import materialised

DIMENSIONS = ["a", "b", "c"]


def fact(spark, n=30_000):
    """Customers from negative numbers to beyond several buckets; most have one value of a; some values are NULL."""
    return spark.range(n).select(
        F.when(F.col("id") % 89 != 0, F.pmod(F.xxhash64("id"), 100_000) - 200).alias("customer_id"),
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 4)).alias("a"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("b"), F.pmod(F.hash("id"), 3))).alias("b"),
        (F.col("id") % 5).alias("c"),
    )


@pytest.fixture(scope="module")
def index(spark):
    return materialised(bitmaps.dimension_bitmaps(fact(spark), DIMENSIONS), "bitmaps")


def test_every_value(spark, index):
    expected = []
    for d in DIMENSIONS:
        counts = fact(spark).groupBy(d).agg(F.count_distinct("customer_id"))
        expected += [(d, None if v is None else str(v), n) for v, n in tuples(counts)]
    assert sorted(tuples(bitmaps.value_customers(index)), key=str) == sorted(expected, key=str)


def having(spark, d, v):
    value = F.col(d).cast("string")
    return fact(spark).where(value.eqNullSafe(F.lit(v)) & F.col("customer_id").isNotNull()).select("customer_id").distinct()


@pytest.mark.parametrize(("one", "other"), list(itertools.combinations(DIMENSIONS, 2)))
def test_every_pair_of_values(spark, index, one, other):
    found = {(r[0], r[1]): r[2] for r in bitmaps.pair_customers(index, one, other).collect()}
    left = fact(spark).select("customer_id", F.col(one).cast("string").alias("x")).where("customer_id IS NOT NULL").distinct()
    right = fact(spark).select("customer_id", F.col(other).cast("string").alias("y")).distinct()
    expected = left.join(right, "customer_id").groupBy("x", "y").agg(F.count_distinct("customer_id"))
    assert found == {(x, y): n for x, y, n in tuples(expected)}


@pytest.mark.parametrize(
    "wanted",
    [{"a": "hot"}, {"a": "hot", "b": "b1"}, {"a": ["a0", "a3"], "b": ["b0", "b2"], "c": "4"}, {"a": "none"}, {"a": "hot", "b": "none"}],
)
def test_combinations(spark, index, wanted):
    sets = []
    for d, values in wanted.items():
        values = [values] if isinstance(values, str) else values
        sets.append({r[0] for v in values for r in having(spark, d, v).collect()})
    assert tuples(bitmaps.combination_customers(index, wanted)) == [(len(set.intersection(*sets)),)]


def test_all_filters_nothing(spark, index):
    everybody = fact(spark).select(F.count_distinct("customer_id")).first()[0]
    for wanted in ({}, {"a": "All Things"}, {"b": []}):
        assert tuples(bitmaps.combination_customers(index, wanted)) == [(everybody,)]


def test_the_plan_reads_the_index_only(spark, index):
    text = plan(bitmaps.combination_customers(index, {"a": "hot", "b": "b1"}))
    assert text.count("FileScan") == 1 and "Range" not in text and "bitmaps" in text


def test_numbers_for_ids_that_are_not_dense(spark):
    ids = spark.sql("SELECT explode(array('z', 'b', NULL, 'b', 'a')) AS k")
    assert sorted(tuples(bitmaps.numbered(ids, "k"))) == [("a", 1), ("b", 2), ("z", 3)]


def test_empty(spark):
    index = bitmaps.dimension_bitmaps(fact(spark, 0), DIMENSIONS)
    assert tuples(bitmaps.combination_customers(index, {"a": "hot"})) == [(0,)]
    assert tuples(bitmaps.pair_customers(index, "a", "b")) == []
