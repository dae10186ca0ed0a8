"""Totals and distinct customers of any list of labels from one aggregation.

Each customer is a mask, one bit per label they have in the window; there are at most two to the power of the labels different
masks. A list's customers are those whose mask shares a bit with it: all customers less those whose mask lies in the list's
complement. The latter are sums over subsets, found for all lists at once label by label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.operators.filters import Day, date_range, dim_filter, label_in

MOST_LABELS = 20


def _bit(labels: Sequence[str]):
    """The bit of a row's label."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    return F.pow(F.lit(2.0), place - 1).cast("bigint")


def label_masks(fact: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(mask, users): how many customers have exactly these of the labels. Rows without a customer are left out.

    Customers are summed per task before they meet; what is left is one row per mask.
    """
    if len(set(labels)) != len(labels) or not 0 < len(labels) <= MOST_LABELS:
        raise ValueError(f"from 1 to {MOST_LABELS} different labels, please")
    chosen = label_in(fact, labels).where(F.col("customer_id").isNotNull())
    per_customer = chosen.groupBy("customer_id").agg(F.bit_or(_bit(labels)).alias("mask"))
    return per_customer.groupBy("mask").agg(F.count(F.lit(1)).alias("users"))


def subset_sums(masks: DataFrame, bits: int, value: str = "users") -> DataFrame:
    """For every mask of ``bits`` bits, the sum over the masks that lie in it.

    One bit at a time: what has not the bit also counts for the mask that has it. Every step is a sum over two to the
    power of ``bits`` rows at most.
    """
    every = masks.sparkSession.range(1 << bits).select(F.col("id").alias("mask"), F.lit(0).cast("bigint").alias(value))
    sums = masks.select("mask", value).unionByName(every).groupBy("mask").agg(F.sum(value).alias(value))
    for bit in range(bits):
        flag = F.lit(1 << bit).cast("bigint")
        both = F.when(F.col("mask").bitwiseAND(flag) == 0, F.array("mask", F.col("mask") + flag)).otherwise(F.array("mask"))
        sums = sums.select(F.explode(both).alias("mask"), value).groupBy("mask").agg(F.sum(value).alias(value))
    return sums


def every_list(
    fact: DataFrame, labels: Sequence[str], first: Day, last: Day, filters: Mapping[str, str] | Sequence[str] | None = None
) -> DataFrame:
    """(mask, labels, total, unique_users) of every non-empty list of the labels, in one pass over the fact.

    ``mask`` has a bit per label, ``labels`` names them in order. A customer with several labels of a list counts once.
    """
    whole = (1 << len(labels)) - 1
    window = dim_filter(date_range(fact, first, last), filters)
    outside = subset_sums(label_masks(window, labels), len(labels))
    counted = outside.select(
        (F.lit(whole).cast("bigint") - F.col("mask")).alias("mask"),
        (outside.agg(F.max("users")).scalar() - F.col("users")).alias("unique_users"),
    )
    per_label = label_in(window, labels).groupBy("label").agg(F.sum("count").alias("n"))
    # A list's total is a sum over its labels: the mask of a single label counts for all masks that hold it.
    totals = subset_sums(per_label.select(_bit(labels).alias("mask"), "n"), len(labels), "n")
    names = F.filter(
        F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.lit(x)) for k, x in enumerate(labels)]),
        lambda x: x.isNotNull(),
    )
    joined = counted.join(totals, "mask").where("mask > 0")
    return joined.select("mask", F.array_join(names, ", ").alias("labels"), F.col("n").alias("total"), "unique_users")


def list_summaries(
    fact: DataFrame,
    lists: Mapping[str, Sequence[str]],
    first: Day,
    last: Day,
    filters: Mapping[str, str] | Sequence[str] | None = None,
) -> DataFrame:
    """(name, total, unique_users) of the named lists, from one pass over the fact, whatever their number.

    The masks are held against each list instead of being summed over all subsets, so there may be many labels together.
    """
    labels = list(dict.fromkeys(x for own in lists.values() for x in own))
    window = dim_filter(date_range(fact, first, last), filters)
    per_customer = label_in(window, labels).groupBy("customer_id").agg(
        F.collect_set("label").alias("own"), F.sum("count").alias("n")
    )
    per_label = label_in(window, labels).groupBy("label").agg(F.sum("count").alias("n"))
    users = [
        F.count_if(F.arrays_overlap("own", F.array(*[F.lit(x) for x in own])) & F.col("customer_id").isNotNull()).alias(f"u{k}")
        for k, own in enumerate(lists.values())
    ]
    sums = [F.sum(F.when(F.col("label").isin(list(own)), F.col("n"))).alias(f"t{k}") for k, own in enumerate(lists.values())]
    counted, total = per_customer.agg(F.struct(*users).alias("u")), per_label.agg(F.struct(*sums).alias("t"))
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.col(f"t.t{k}").alias("total"), F.col(f"u.u{k}").alias("unique_users"))
            for k, name in enumerate(lists)
        ]
    )
    return counted.select("u", total.scalar().alias("t")).select(F.inline(rows))
