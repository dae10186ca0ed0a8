"""Positions, running sums and pages against their window versions, with hot values, NULLs and empty tables."""

import re

import pytest
from helpers import plan, tuples
from pyspark.sql import Window
from pyspark.sql import functions as F

from badgewright.operators import prefix
from badgewright.sources.files import scratch_path


def table(spark, n=5000, hot=3):
    """Half of the rows share one value of k."""
    k = F.when(F.col("id") % 2 == 0, F.lit(hot)).when(F.col("id") % 101 == 0, None).otherwise(F.pmod(F.hash("id"), 97))
    v = F.when(F.col("id") % 53 != 0, F.col("id") % 1000 - 300)
    return spark.range(n).select("id", k.alias("k"), v.alias("v"))


def test_positions_equal_the_window(spark):
    df = table(spark)
    found = prefix.positions(df, ["k", F.desc("v"), "id"], parts=13)
    order = Window.orderBy(F.col("k"), F.desc("v"), F.col("id"))
    assert sorted(tuples(found, "id", "position")) == sorted(tuples(df.select("id", F.row_number().over(order))))


def test_running_sum_equals_the_window(spark):
    df = table(spark)
    found = prefix.running_sum(df, ["k", "id"], "v", parts=13)
    order = Window.orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select("id", F.coalesce(F.sum("v").over(order), F.lit(0)))
    assert sorted(tuples(found, "id", "running")) == sorted(tuples(expected))
    assert found.columns == ["id", "k", "v", "running"]


def test_running_total_of_hot_and_null_keys(spark):
    df = table(spark)
    found = tuples(prefix.running_total(df, "k", "v", parts=7), "k", "v", "running")
    sums = tuples(df.groupBy("k").agg(F.sum("v")))
    total, expected = 0, []
    for key, value in sorted(sums, key=lambda r: (r[0] is not None, r[0])):
        total += value
        expected.append((key, value, total))
    assert sorted(found, key=lambda r: (r[0] is not None, r[0])) == expected


def test_a_hot_value_is_spread(spark):
    df = spark.range(8000).select("id", F.lit(1).alias("k"))
    held = prefix._ordered(df, ["k"], 8).groupBy(prefix.PART).count()
    counts = [r["count"] for r in held.collect()]
    assert len(counts) == 8 and max(counts) < 3000


def test_no_window_over_all_rows_and_offsets_are_small(spark):
    text = plan(prefix.running_sum(table(spark), ["k", "id"], "v"))
    # The one single-partition exchange is below the window over the parts' totals.
    assert text.count("SinglePartition") == 1 and re.search(r"hashpartitioning\(_part", text)
    assert plan(prefix.positions(table(spark), ["k"])).count("SinglePartition") == 1


def test_pages_equal_offset_and_limit(spark):
    df = table(spark)
    pages = prefix.write_pages(df, ["k", "id"], scratch_path(spark, "pages"), parts=9)
    assert tuples(pages.count()) == [(5000,)]
    for number, rows in ((1, 50), (17, 33), (100, 50), (101, 50), (1, 5000), (3, 2000), (7, 1)):
        expected = df.orderBy("k", "id").offset((number - 1) * rows).limit(rows)
        assert tuples(pages.page(number, rows)) == tuples(expected)
    assert pages.page(2).columns == df.columns


def test_a_page_reads_its_part_only(spark):
    pages = prefix.write_pages(table(spark), ["id"], scratch_path(spark, "pages"), parts=10)
    page = pages.page(60, 50)
    assert page.count() == 50
    filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan(page))
    assert filters and re.fullmatch(r".*_part#\d+ (IN \(\d+,\d+\)|= \d+).*", filters[0])
    assert len(spark.read.parquet(pages._rows).inputFiles()) >= 10


@pytest.mark.parametrize("build", ["positions", "running_sum"])
def test_empty(spark, build):
    df = table(spark, 0)
    args = (["id"],) if build == "positions" else (["id"], "v")
    assert getattr(prefix, build)(df, *args).count() == 0
    pages = prefix.write_pages(df, ["id"], scratch_path(spark, "pages"))
    assert pages.page(1).count() == 0 and tuples(pages.count()) == [(0,)]
