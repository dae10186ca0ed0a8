"""Joins that hold when one key has a third of all rows.

``enrich`` joins a fact with a dimension on one key. A dimension that is small, by
what it reads and by its own plan, is broadcast. Otherwise both sides are shuffled. Where
adaptive execution handles skewed joins, it splits the fact's rows of a hot key (or of NULL) at
run time, and nothing is counted before. Elsewhere the rows of every hot key are spread over as many
salts as they fill tasks, with the dimension's rows of that key repeated once per salt, and rows whose
key is NULL are spread as well. No row is dropped, so the result is that of a plain join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = "spark.badgewright.hotKey.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000
MAX_HOT_KEYS = 100_000
NULL_KEY_SALTS = 65_536
EXPAND_BLOCK = 65_536


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the relations a DataFrame reads, None where the session cannot tell."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except AttributeError:
        return None


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of a DataFrame's own rows as Spark estimates them, None where the session cannot tell."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def fits_broadcast(df: DataFrame) -> bool:
    """Whether all that a DataFrame reads, and what it makes of it, is within Spark's own broadcast limit."""
    limit = _bytes_setting(df.sparkSession, "spark.sql.autoBroadcastJoinThreshold")
    sizes = (input_bytes(df), plan_bytes(df))
    return all(size is not None and size <= limit for size in sizes)


def skew_is_handled(spark: SparkSession) -> bool:
    """Whether adaptive execution splits the skewed partitions of every inner and left join."""
    needed = ("enabled", "skewJoin.enabled", "forceOptimizeSkewedJoin")
    return all(spark.conf.get(f"spark.sql.adaptive.{name}", "false") == "true" for name in needed)


def _bytes_setting(spark: SparkSession, name: str) -> int:
    text = spark.conf.get(name).strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    number = text.removesuffix("b")
    factor = units.get(number[-1:], 1)
    return int(float(number.rstrip("kmgt")) * factor)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys with more rows than a task should hold, and the number of salts for each.

    A hot key has more than 1 / MAX_HOT_KEYS of all rows, so there are fewer
    than MAX_HOT_KEYS of them: the result can be broadcast at any scale.
    """
    per_task = int(rows.sparkSession.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    all_rows = counts.agg(F.sum("_rows")).scalar()
    limit = F.greatest(F.lit(float(per_task)), all_rows / F.lit(MAX_HOT_KEYS))
    hot = counts.where(F.col("_rows") > limit)
    return hot.select(key, F.ceil(F.col("_rows") / limit).cast("int").alias("_salts"))


def enrich(
    fact: DataFrame,
    dimension: DataFrame,
    key: str,
    how: str = "inner",
    spread: Sequence[str | Column] | None = None,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Join ``fact`` with ``dimension`` on ``key`` ("inner" or "left").

    ``spread`` names the fact columns whose hash picks the salt; they should tell
    the rows of one key apart (default: all other columns). ``count_from`` are rows
    to count the keys in, where they are cheaper to read than ``fact``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"enrich joins inner or left, not {how}")
    if fits_broadcast(dimension):
        return fact.join(F.broadcast(dimension), key, how)

    spread = spread or [c for c in fact.columns if c != key]
    if skew_is_handled(fact.sparkSession) or not spread:
        return fact.join(dimension, key, how)
    row_hash = F.xxhash64(*spread)

    hot = hot_keys(fact if count_from is None else count_from, key)
    salts_of_key = F.coalesce("_salts", F.lit(1))
    salt_of_row = F.when(F.col(key).isNull(), F.pmod(row_hash, F.lit(NULL_KEY_SALTS))).otherwise(
        F.pmod(row_hash, salts_of_key)
    )
    salted_fact = (
        fact.join(F.broadcast(hot), key, "left").withColumn("_salt", salt_of_row.cast("int")).drop("_salts")
    )
    salted_dimension = (
        dimension.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts_of_key - 1)))
        .drop("_salts")
    )
    return salted_fact.join(salted_dimension, [key, "_salt"], how).drop("_salt")


def join_many(one: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """Left join of a table of unique keys with one that may have most of its rows in one key.

    A left join cannot split its right side, so the matches are found from the
    side that has many rows, and the rows without a match are added. Equal rows are counted
    before the join and made again after it in blocks over all tasks, so that a key whose rows are all
    equal is no hot spot either.
    """
    if fits_broadcast(many):
        return one.join(F.broadcast(many), key, "left")
    columns = [c for c in many.columns if c != key]
    counted = many.where(F.col(key).isNotNull()).groupBy(*many.columns).agg(F.count(F.lit(1)).alias("_times"))
    matched = enrich(counted, one, key, spread=columns)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1, F.lit(EXPAND_BLOCK).cast("bigint")))
    blocks = matched.withColumn("_block", starts).repartition(*many.columns, "_block")
    last = F.least(F.col("_block") + EXPAND_BLOCK, F.col("_times")) - 1
    rows = blocks.withColumn("_row", F.explode(F.sequence("_block", last))).drop("_times", "_block", "_row")
    missing = one.join(many.select(key).distinct(), key, "left_anti")
    return rows.unionByName(missing, allowMissingColumns=True).select(
        key, *[c for c in (*one.columns, *many.columns) if c != key]
    )


def counted_rows(rows: DataFrame) -> DataFrame:
    """Equal rows put together, with their ``count``: the grain of every fact, whatever joins follow."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("count"))
