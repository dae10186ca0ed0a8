from collections import Counter

import pytest
from helpers import plan, tuples
from pyspark.sql import functions as F

from badgewright.operators.joins import counted_rows, enrich, fits_broadcast, hot_keys, join_many


@pytest.fixture
def fact(spark):
    """400 rows: key 1 has half of them, NULL a quarter, the rest is spread."""
    key = F.when(F.col("id") % 2 == 0, F.lit(1)).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.col("id"))
    return spark.range(400).select("id", key.cast("bigint").alias("key"))


@pytest.fixture
def dimension(spark):
    """Key 1 twice, some others once, one that no row has."""
    rows = [(1, "a"), (1, "b"), (3, "c"), (7, "d"), (-5, "e"), (None, "f")]
    return spark.createDataFrame(rows, "key bigint, name string")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, no_broadcast, fact, dimension, how):
    plain = Counter(tuples(fact.join(dimension, "key", how)))
    salted = enrich(fact, dimension, "key", how)
    assert "_salt" in plan(salted)
    assert Counter(tuples(salted)) == plain
    assert salted.columns == ["key", "id", "name"]
    assert Counter(tuples(enrich(fact, dimension, "key", how, spread=["id"], count_from=fact))) == plain


@pytest.mark.parametrize("how", ["inner", "left"])
def test_adaptive_execution_splits_a_hot_key_without_counting(spark, settings, fact, dimension, how):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="1k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.1",
    )
    many = fact.repartition(20).unionByName(fact.repartition(20)).withColumn("pad", F.repeat(F.uuid(), 20))
    joined = enrich(many, dimension, "key", how)
    assert "_salt" not in plan(joined)
    per_task = joined.where("key = 1").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 800 and len(per_task) > 1


def test_left_join_with_many_rows_in_one_key(spark, settings, fact):
    one = spark.createDataFrame([(1, "a"), (3, "b"), (-5, "c"), (None, "d")], "key bigint, name string")
    many = fact.where("key is null or key < 50")
    plain = Counter(tuples(one.join(many, "key", "left")))
    assert Counter(tuples(join_many(one, many, "key"))) == plain
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__enabled="false",
        spark__badgewright__hotKey__rowsPerTask="20",
    )
    salted = join_many(one, many, "key")
    assert salted.columns == ["key", "name", "id"] and "_salt" in plan(salted)
    assert Counter(tuples(salted)) == plain


def test_hot_key_is_spread_over_partitions(spark, no_broadcast, settings, fact, dimension):
    settings(spark__sql__adaptive__enabled="false")
    joined = enrich(fact, dimension, "key", "left").where("key = 1")
    assert joined.select(F.spark_partition_id()).distinct().count() > 1
    nulls = enrich(fact, dimension, "key", "left").where("key is null")
    assert nulls.select(F.spark_partition_id()).distinct().count() > 1


def test_hot_keys_have_salts_for_their_rows(spark, no_broadcast, fact):
    assert tuples(hot_keys(fact, "key")) == [(1, 10)]


def test_no_hot_keys(spark, fact):
    assert hot_keys(fact, "key").count() == 0


def test_small_dimension_is_broadcast(spark, tmp_path, fact, dimension):
    path = str(tmp_path / "dimension")
    dimension.write.parquet(path)
    stored = spark.read.parquet(path)
    assert fits_broadcast(stored)
    joined = enrich(fact, stored, "key", "left")
    assert "BroadcastHashJoin" in plan(joined) and "_salt" not in plan(joined)
    assert joined.count() == fact.join(dimension, "key", "left").count()


def test_size_check_counts_what_a_join_reads(spark, tmp_path, settings, dimension):
    path = str(tmp_path / "dimension")
    dimension.write.parquet(path)
    stored = spark.read.parquet(path)
    both = stored.join(stored.withColumnRenamed("name", "other"), "key")
    settings(spark__sql__autoBroadcastJoinThreshold="1kb")
    assert fits_broadcast(stored.limit(1)) == fits_broadcast(stored)
    settings(spark__sql__autoBroadcastJoinThreshold="1g")
    assert fits_broadcast(both)
    settings(spark__sql__autoBroadcastJoinThreshold="10")
    assert not fits_broadcast(both)


def test_only_inner_and_left(fact, dimension):
    with pytest.raises(ValueError, match="full"):
        enrich(fact, dimension, "key", "full")


def test_fact_of_keys_alone(spark, no_broadcast, fact, dimension):
    keys = fact.select("key")
    assert enrich(keys, dimension, "key").count() == fact.join(dimension, "key").count()


def test_equal_rows_are_counted_at_every_size(spark, settings):
    rows = spark.sql("SELECT explode(array(1, 1, 2)) AS k")
    for limit in ("10m", "-1"):
        settings(spark__sql__autoBroadcastJoinThreshold=limit)
        assert sorted(tuples(counted_rows(rows))) == [(1, 2), (2, 1)]


def test_what_a_join_multiplies_is_not_broadcast(spark, tmp_path, settings):
    path = str(tmp_path / "small")
    spark.range(200).selectExpr("id % 2 AS key", "repeat('x', 50) AS text").write.parquet(path)
    small = spark.read.parquet(path)
    grown = small.join(small.withColumnRenamed("text", "other"), "key")
    settings(spark__sql__autoBroadcastJoinThreshold="20k")
    assert fits_broadcast(small) and not fits_broadcast(grown)


def test_equal_rows_of_one_key_are_spread(spark, no_broadcast, settings):
    """One user gave almost all answers, all of them equal."""
    settings(spark__sql__adaptive__enabled="false")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "key bigint, name string")
    many = spark.range(400_000).selectExpr("1L AS key", "'same' AS answer")
    joined = join_many(one, many, "key")
    per_task = joined.where("key = 1").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 400_000 and len(per_task) > 1
    assert tuples(joined.where("key = 2")) == [(2, "b", None)]
