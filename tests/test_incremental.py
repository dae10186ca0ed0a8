"""Loads that rewrite changed days only: equal to a rebuild, atomic, and safe to break off."""

import datetime

import pytest
from helpers import plan, tuples
from pyspark.sql import functions as F
from pyspark.sql import types as T

from badgewright.sources.files import scratch_path
from badgewright.sources.incremental import DayStore, settled

SOURCE = "event_date date, user bigint, kind string"


def day(n):
    return datetime.date(2024, 1, n)


def events(spark, days):
    """Rows (day, user, kind) for {day: users}."""
    return spark.createDataFrame([(day(d), u, "a" if u % 2 else None) for d, users in days.items() for u in users], SOURCE)


def build(source):
    return source.groupBy("event_date", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("user").alias("users"))


@pytest.fixture
def store(spark):
    schema = build(events(spark, {})).schema
    return DayStore(spark, scratch_path(spark, "day-store"), T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def state(df):
    return sorted(tuples(df), key=str)


def files_of(df):
    found = df.select("event_date", F.input_file_name().alias("file")).distinct().collect()
    return {r["event_date"]: r["file"] for r in found}


DAYS = {1: [1, 2, 3], 2: [4], 3: [5, 6], 4: [7]}


def test_only_changed_days_are_rewritten(spark, store):
    first = store.refresh(events(spark, DAYS), build)
    assert (first.version, first.built) == (1, (day(1), day(2), day(3), day(4)))
    before = files_of(store.read())
    later = {**DAYS, 2: [4, 8], 5: [9]}
    second = store.refresh(events(spark, later), build)
    assert (second.built, second.kept, second.dropped) == ((day(2), day(5)), (day(1), day(3), day(4)), ())
    after = files_of(store.read())
    assert state(store.read()) == state(build(events(spark, later)))
    assert {d for d in after if after[d] != before.get(d)} == {day(2), day(5)}
    assert "load=2" in after[day(2)] and "load=1" in after[day(3)]
    assert state(store.read(version=1)) == state(build(events(spark, DAYS)))


def test_nothing_changed_writes_nothing(spark, store):
    store.refresh(events(spark, DAYS), build)
    again = store.refresh(events(spark, DAYS).repartition(5), build)
    assert (again.version, again.built, store.version()) == (1, (), 1)


def test_days_that_went_are_dropped_and_rows_without_a_day_are_in_none(spark, store):
    store.refresh(events(spark, DAYS), build)
    rest = events(spark, {k: v for k, v in DAYS.items() if k != 3})
    load = store.refresh(rest.unionByName(spark.createDataFrame([(None, 1, "x")], SOURCE)), build)
    assert (load.built, load.dropped) == ((), (day(3),))
    assert state(store.read()) == state(build(rest))


@pytest.mark.parametrize("users", [[4, 4], [], [5]])
def test_a_change_of_any_kind_is_seen(spark, store, users):
    """A repeated row, a day that goes, another value in as many rows."""
    store.refresh(events(spark, DAYS), build)
    store.refresh(events(spark, {**DAYS, 2: users}), build)
    assert state(store.read()) == state(build(events(spark, {**DAYS, 2: users})))


def test_a_load_that_breaks_off_leaves_the_old_state(spark, store):
    store.refresh(events(spark, DAYS), build)
    later = events(spark, {**DAYS, 1: [1], 5: [9]})

    def fails(source):
        broken = F.when(F.col("event_date") == F.lit(day(5)), F.raise_error(F.lit("lost"))).otherwise(F.col("n"))
        return build(source).withColumn("n", broken)

    with pytest.raises(Exception, match="lost"):
        store.refresh(later, fails)
    assert store.version() == 1 and state(store.read()) == state(build(events(spark, DAYS)))
    assert store.refresh(later, build).built == (day(1), day(5))
    assert state(store.read()) == state(build(later))


def test_data_without_a_manifest_is_not_read(spark, store):
    store.refresh(events(spark, DAYS), build)
    # A load that wrote its days and was lost before its manifest; and a manifest that was begun.
    build(events(spark, {1: [99]})).withColumnRenamed("event_date", "day").write.partitionBy("day").parquet(f"{store.root}/data/load=2")
    begun = f"{store.root}/manifest/version=3"
    store.manifest().write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(begun)
    assert store.version() == 1 and state(store.read()) == state(build(events(spark, DAYS)))
    later = events(spark, {**DAYS, 4: [1]})
    assert store.refresh(later, build).version == 4
    assert state(store.read()) == state(build(later))
    assert store.remove_unnamed() == [2] and state(store.read()) == state(build(later))


def test_a_final_shard_takes_the_place_of_the_intraday_one(spark, store):
    daily, intraday = events(spark, {1: [1, 2]}), events(spark, {2: [3], 3: [4]})
    store.refresh(settled(daily, intraday), build)
    ended = events(spark, {1: [1, 2], 2: [3, 5, 6]})
    load = store.refresh(settled(ended, events(spark, {2: [3], 3: [4, 7]})), build)
    assert (load.built, load.kept) == ((day(2), day(3)), (day(1),))
    assert state(store.read()) == state(build(events(spark, {1: [1, 2], 2: [3, 5, 6], 3: [4, 7]})))


def test_a_range_reads_its_days(spark, store):
    store.refresh(events(spark, DAYS), build)
    part = store.read("2024-01-02", "2024-01-03")
    assert {r["event_date"] for r in part.collect()} == {day(2), day(3)}
    assert "day" in plan(part).split("PartitionFilters")[1].split("PushedFilters")[0]


def test_empty(spark, store):
    assert store.version() == 0 and store.read().count() == 0
    load = store.refresh(events(spark, {}), build)
    assert load.version == 0 and store.read().count() == 0
    store.refresh(events(spark, DAYS), build)
    assert store.refresh(events(spark, {}), build).dropped == (day(1), day(2), day(3), day(4))
    assert store.read().count() == 0 and store.read().columns == ["event_date", "kind", "n", "users"]


def test_sketches_are_loaded_by_day(spark):
    """Daily sketches kept by day: a load makes those of the changed days only, and windows follow."""
    from badgewright.plans import daily, kpis

    def facts(users):
        rows = [(u, "x" if u % 3 else "y", day(d), 1) for d, own in users.items() for u in own]
        return spark.createDataFrame(rows, "customer_id bigint, label string, date date, count bigint")

    first = {d: range(d, d + 40) for d in range(1, 15)}
    schema = daily.daily_sketches(facts({1: [1]})).schema
    kept = DayStore(spark, scratch_path(spark, "sketch-store"), schema, day="date")
    kept.refresh(facts(first), daily.daily_sketches)
    later = {**first, 9: range(500, 530), 15: range(3)}
    assert kept.refresh(facts(later), daily.daily_sketches).built == (day(9), day(15))
    window = ("2024-01-08", "2024-01-14")
    assert tuples(daily.sketched_tiles(kept.read(), *window)) == tuples(kpis.kpi_tiles(facts(later), *window))
    expected = facts(later).where("date BETWEEN '2024-01-08' AND '2024-01-14'").groupBy("label").agg(F.sum("count"), F.count_distinct("customer_id"))
    assert sorted(tuples(daily.sketched_measures(kept.read(), *window))) == sorted(tuples(expected))
