"""All lists of labels from one pass, against the subtotal of each."""

import itertools

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from badgewright.fixed import BADGE_REPORTS
from badgewright.plans import label_lists, reports


def fact(spark, labels, n=4000):
    """One label has half of the rows; a label or a customer may be NULL."""
    names = F.array(*[F.lit(x) for x in [*labels, None]])
    label = F.when(F.col("id") % 2 == 0, labels[0]).otherwise(F.get(names, F.pmod(F.hash("id"), len(labels) + 1)))
    return spark.range(n).select(
        F.when(F.col("id") % 41 != 0, F.pmod(F.xxhash64("id"), 300)).alias("customer_id"),
        label.alias("label"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("date"),
        (F.col("id") % 4).alias("count"),
        F.concat(F.lit("g"), F.col("id") % 2).alias("gender"),
    )


WINDOW = ("2024-01-05", "2024-01-20")


def subtotal(df, labels, filters=None):
    row = reports.badge_subtotal(df, labels, *WINDOW, filters=filters).first()
    return (row["total"], row["unique_users"]) if row else (None, 0)


def test_every_list_equals_its_subtotal(spark):
    labels = ["x", "y", "z", "never"]
    df = fact(spark, labels[:3])
    found = {r["labels"]: (r["total"], r["unique_users"]) for r in label_lists.every_list(df, labels, *WINDOW).collect()}
    assert len(found) == 15
    for size in (1, 2, 3, 4):
        for own in itertools.combinations(labels, size):
            total, users = subtotal(df, own)
            assert found[", ".join(own)] == (total or 0, users)


def test_the_lists_of_the_reports(spark):
    lists = dict(BADGE_REPORTS)
    labels = list(dict.fromkeys(x for own in lists.values() for x in own))
    df = fact(spark, labels)
    for filters in (None, {"gender": "g1"}):
        found = label_lists.list_summaries(df, lists, *WINDOW, filters=filters).collect()
        assert {r["name"]: (r["total"], r["unique_users"]) for r in found} == {k: subtotal(df, v, filters) for k, v in lists.items()}


def test_subset_sums(spark):
    masks = spark.createDataFrame([(0, 1), (3, 10), (5, 100), (5, 1000)], "mask bigint, users bigint")
    found = dict(tuples(label_lists.subset_sums(masks, 3)))
    rows = [(0, 1), (3, 10), (5, 1100)]
    assert found == {s: sum(n for m, n in rows if m & s == m) for s in range(8)}


def test_empty_and_refused(spark):
    df = fact(spark, ["x"], 0)
    found = label_lists.every_list(df, ["x", "y"], *WINDOW).collect()
    assert sorted((r["mask"], r["total"], r["unique_users"]) for r in found) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    with pytest.raises(ValueError, match="different labels"):
        label_lists.every_list(df, ["x", "x"], *WINDOW)
