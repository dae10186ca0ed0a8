"""Which customers have which dimension value, as bitmaps: unique customers of any combination without the fact.

A bitmap covers 32,768 customer numbers (4 KB); a row is a dimension, a value and a bucket of numbers. Customers of a combination
are the bits that all of its values' bitmaps share. Numbers should be dense: ids that are not are numbered first
(``numbered``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.operators.prefix import positions

DIMENSION, VALUE, BUCKET, BITS = "dimension", "value", "bucket", "bits"


def numbered(customers: DataFrame, key: str, name: str = "customer_number") -> DataFrame:
    """Each different ``key`` with a number from 1, dense, in the order of the keys; NULL has none."""
    keys = customers.where(F.col(key).isNotNull()).select(key).distinct()
    return positions(keys, [key], name)


def dimension_bitmaps(fact: DataFrame, dimensions: Sequence[str], customer: str = "customer_id") -> DataFrame:
    """(dimension, value, bucket, bits): who has the value in some row of the fact. A value may be NULL, a customer not.

    Rows are cut to the different combinations of a customer before they are made tall. Bitmaps are built per task and
    merged, so a value that most customers have is no hot spot.
    """
    pairs = ", ".join(f"'{d}', cast(`{d}` as string)" for d in dimensions)
    some = fact.where(F.col(customer).isNotNull()).select(F.col(customer).cast("bigint").alias("_c"), *dimensions).distinct()
    tall = some.select("_c", F.expr(f"stack({len(dimensions)}, {pairs}) as ({DIMENSION}, {VALUE})"))
    bucket = F.bitmap_bucket_number("_c").alias(BUCKET)
    return tall.groupBy(DIMENSION, VALUE, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_c")).alias(BITS))


def value_customers(bitmaps: DataFrame) -> DataFrame:
    """Unique customers of every value."""
    return bitmaps.groupBy(DIMENSION, VALUE).agg(F.sum(F.bitmap_count(BITS)).alias("unique_users"))


def combination_customers(bitmaps: DataFrame, filters: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """One row: customers that have one of the wanted values in every dimension. ``All...`` and no value filter nothing.

    Values of one dimension are merged, dimensions intersected, bucket by bucket.
    """
    wanted = {d: [v] if isinstance(v, str) else list(v) for d, v in filters.items()}
    wanted = {d: v for d, v in wanted.items() if v and not any(x.startswith("All") for x in v)}
    if not wanted:
        # Everybody: a customer has some value, or NULL, in any one dimension.
        one = bitmaps.agg(F.min(DIMENSION)).scalar()
        chosen, dimensions = bitmaps.where(F.col(DIMENSION) == one), 1
    else:
        condition = F.lit(False)
        for dimension, values in wanted.items():
            condition = condition | ((F.col(DIMENSION) == dimension) & F.col(VALUE).isin(values))
        chosen, dimensions = bitmaps.where(condition), len(wanted)
    either = chosen.groupBy(BUCKET, DIMENSION).agg(F.bitmap_or_agg(BITS).alias(BITS))
    both = either.groupBy(BUCKET).agg(F.bitmap_and_agg(BITS).alias(BITS), F.count(F.lit(1)).alias("n"))
    shared = both.where(F.col("n") == dimensions)
    return shared.agg(F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0).cast("bigint")).alias("unique_users"))


def pair_customers(bitmaps: DataFrame, one: str, other: str) -> DataFrame:
    """(one, other, unique_users) of every pair of values that some customer has. Buckets meet by equality."""
    left = bitmaps.where(F.col(DIMENSION) == one).select(BUCKET, F.col(VALUE).alias(one), F.col(BITS).alias("_a"))
    right = bitmaps.where(F.col(DIMENSION) == other).select(BUCKET, F.col(VALUE).alias(other), F.col(BITS).alias("_b"))
    met = left.join(right, BUCKET).select(BUCKET, one, other, F.explode(F.array("_a", "_b")).alias(BITS))
    shared = met.groupBy(BUCKET, one, other).agg(F.bitmap_and_agg(BITS).alias(BITS))
    counted = shared.groupBy(one, other).agg(F.sum(F.bitmap_count(BITS)).alias("unique_users"))
    return counted.where("unique_users > 0")
