"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from badgewright.catalog.adapters import Tables
from badgewright.functions import dayparts, labels, numbers, regions
from badgewright.operators import aggregates, display, filters, periods, prefix
from badgewright.plans import bitmaps, cubes, daily, kpis, reports
from badgewright.plans import label_lists as label_lists_of
from badgewright.sources import csv_split, files, incremental
from badgewright.sources.lookups import postal_district

Query = Callable[[SparkSession, str], DataFrame]

FIRST, LAST = "2024-01-24", "2024-01-30"
LABELS = ["purchase", "click", "view", "error"]
ORDERS_FIRST, ORDERS_LAST = "2001-06-01", "2001-06-30"
ORDERS_AS_OF = "2001-07-15"
GOALS = [f"{m} Minutes Milestone" for m in (50, 10, 20, 30, 40)]
GOALS_FIRST, GOALS_LAST = "1997-01-01", "1998-12-31"
REWARDS_FIRST, REWARDS_LAST = "1996-01-01", "2000-12-31"
REWARD_LABELS = ["red widget", "blue bolt", "cold ring", "old bolt", "es red gear", "24 Minutes Milestone"]
CYCLES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "<NA>"]
DIMENSIONS = ["age", "month", "quarter", "gender", "province", "user_selected_level"]
EVERY_DAY = ("1900-01-01", "2999-12-31")
SETTLED_TO = "2024-01-28"
DEEP_PAGE = (30, 40)
BITMAP_DIMENSIONS = ["gender", "age", "province", "user_selected_level", "label"]
BITMAP_WANTED = {"gender": ["BUILDING", "MACHINERY"], "label": "purchase", "age": "All Ages", "user_selected_level": ["1", "2", "3"]}
PRIORITY_LISTS = {"high": ["1-URGENT", "2-HIGH"], "low": ["5-LOW", "4-NOT SPECIFIED"], "ends": ["1-URGENT", "5-LOW"], "one": ["3-MEDIUM"]}

QUERIES: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, root: build(Tables(spark, root))
    return build


@query
def badge_summary(t: Tables) -> DataFrame:
    return reports.badge_summary(t.badge_facts(), LABELS, FIRST, LAST)


@query
def badge_summary_filtered(t: Tables) -> DataFrame:
    wanted = {"gender": "BUILDING", "age": "All Ages", "hour": "Evening", "province": "All Provinces"}
    return reports.badge_summary(t.badge_facts(), LABELS, FIRST, LAST, wanted)


@query
def badge_summary_display(t: Tables) -> DataFrame:
    return reports.badge_summary_display(reports.badge_summary(t.badge_facts(), LABELS, FIRST, LAST))


@query
def badge_subtotal(t: Tables) -> DataFrame:
    return reports.badge_subtotal(t.badge_facts(), LABELS, FIRST, LAST)


@query
def badge_rollup(t: Tables) -> DataFrame:
    return reports.badge_rollup(t.badge_facts(), LABELS, FIRST, LAST)


@query
def badge_delta(t: Tables) -> DataFrame:
    return reports.badge_delta(t.badge_facts(), LABELS, FIRST, LAST)


@query
def badge_histogram(t: Tables) -> DataFrame:
    return reports.badge_histogram(t.badge_facts(), FIRST, LAST)


@query
def badge_histogram_display(t: Tables) -> DataFrame:
    return reports.badge_histogram_display(reports.badge_histogram(t.badge_facts(), FIRST, LAST))


@query
def activity_levels(t: Tables) -> DataFrame:
    return reports.activity_levels(t.badge_facts(), FIRST, LAST)


@query
def activity_goals(t: Tables) -> DataFrame:
    return reports.badge_summary(cubes.badge_cube_sums(*t.badge_tables()), GOALS, GOALS_FIRST, GOALS_LAST)


@query
def daily_series(t: Tables) -> DataFrame:
    return reports.daily_series(t.badge_facts(), FIRST, LAST)


@query
def page_rows(t: Tables) -> DataFrame:
    return display.page(reports.daily_series(t.badge_facts(), *EVERY_DAY), ["date"], number=2, rows=10)


@query
def grand_totals(t: Tables) -> DataFrame:
    return aggregates.grand_totals(t.badge_facts())


@query
def date_range_filter(t: Tables) -> DataFrame:
    return filters.date_range(t.badge_events(), FIRST, LAST).select("event_id", "customer_id", "label", "date")


@query
def dim_filter(t: Tables) -> DataFrame:
    wanted = ["gender", "BUILDING", "label", "All Labels", "user_selected_level", "3"]
    return filters.dim_filter(t.badge_events(), wanted).select("event_id", "customer_id", "label", "date")


@query
def label_in(t: Tables) -> DataFrame:
    return filters.label_in(t.badge_events(), ["purchase", "error"]).select("event_id", "customer_id", "label", "date")


@query
def filter_choices(t: Tables) -> DataFrame:
    reached = cubes.milestone_top(t.customer_award(), t.award(), t.translation())
    return reports.filter_choices((t.badge_facts(), DIMENSIONS), (reached, ["max_award_code"]))


@query
def dim_labels(t: Tables) -> DataFrame:
    text = F.date_format("date", "MM/dd/yyyy")
    return t.badge_events().select(
        "event_id",
        labels.capitalised("gender").alias("gender"),
        labels.age_band("age").alias("age"),
        labels.postal_initial("postal_code").alias("province_postcode"),
        labels.quarter_label("date").alias("quarter"),
        labels.month_label("date").alias("month"),
        labels.weekday_name("date").alias("weekday"),
        labels.date_of_text(text).alias("date"),
        F.hour("created_at").alias("hour"),
    )


@query
def day_parts(t: Tables) -> DataFrame:
    hour = F.hour("ts")
    return t.raw("events").select(
        "event_id",
        dayparts.badge_day_part(hour).alias("badge_part"),
        dayparts.reward_day_part(hour).alias("rewards_part"),
        dayparts.app_day_part(hour).alias("app_part"),
        dayparts.app_day_part(hour, corrected=True).alias("app_part_corrected"),
    )


@query
def label_minutes(t: Tables) -> DataFrame:
    text = F.expr(
        """CASE p_type WHEN 'PROMO' THEN p_size || ' Minutes Milestone'
                       WHEN 'SMALL' THEN 'Weekly Challenge Completed'
                       WHEN 'LARGE' THEN 'Weekly Challenge Complete'
                       WHEN 'ECONOMY' THEN cast(p_size AS string)
                       ELSE upper(p_name) END"""
    )
    return t.raw("part").select(
        "p_partkey",
        labels.title_case(text).alias("title"),
        labels.leading_minutes(text).alias("minutes"),
        labels.weekly_label(text).alias("cleaned"),
    )


@query
def safe_math(t: Tables) -> DataFrame:
    x, y = F.floor("o_totalprice"), F.col("o_custkey") % 50
    text = F.when(F.col("o_orderkey") % 10 == 0, "--").otherwise(F.col("o_totalprice").cast("string"))
    return t.raw("orders").select(
        F.col("o_orderkey").alias("key"),
        numbers.percent_diff(x, y).alias("pct_diff"),
        numbers.percent_diff_text(x, y).alias("pct_text"),
        numbers.safe_round(text, 0).alias("rounded"),
        numbers.thousands(x).alias("grouped"),
    ).fillna(0, subset=["pct_diff"])


@query
def period_table(t: Tables) -> DataFrame:
    days = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    return periods.period_table(days)


@query
def period_rollup(t: Tables) -> DataFrame:
    return periods.period_rollup(t.order_events(), ORDERS_AS_OF)


@query
def kpi_tiles(t: Tables) -> DataFrame:
    return kpis.kpi_tiles(t.order_events(), ORDERS_FIRST, ORDERS_LAST)


@query
def kpi_tiles_display(t: Tables) -> DataFrame:
    tiles = kpis.kpi_tiles(t.order_events(), ORDERS_FIRST, ORDERS_LAST, {"label": "1-URGENT"})
    return kpis.kpi_tiles_display(tiles)


@query
def kpi_growth(t: Tables) -> DataFrame:
    return kpis.kpi_growth(t.order_events(), ORDERS_FIRST, ORDERS_LAST)


@query
def new_users(t: Tables) -> DataFrame:
    return kpis.new_customers(t.badge_facts(), FIRST, LAST, {"label": "purchase"})


@query
def badge_cube(t: Tables) -> DataFrame:
    return cubes.badge_cube(*t.badge_tables())


@query
def badge_cube_province(t: Tables) -> DataFrame:
    sums = cubes.badge_provinces(*t.badge_tables())
    return sums.select("province_postcode", "province_code", "province", "label", "quarter", "n_rows", "count")


@query
def badge_cube_answers(t: Tables) -> DataFrame:
    return cubes.badge_cube_with_answers(*t.badge_tables(), t.answer())


@query
def milestone_codes(t: Tables) -> DataFrame:
    return cubes.milestone_codes(t.award(), t.translation())


@query
def milestone_top(t: Tables) -> DataFrame:
    return cubes.milestone_top(t.customer_award(), t.award(), t.translation())


@query
def onboarding_answer(t: Tables) -> DataFrame:
    answered = cubes.onboarding_answer(t.customer(), t.answer())
    return answered.select(F.col("_uid").alias("customer_id"), "answer")


@query
def rewards_fact(t: Tables) -> DataFrame:
    fact = cubes.rewards_fact(*t.reward_tables())
    return fact.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query
def left_on_theta(t: Tables) -> DataFrame:
    awards = t.award().select(F.col("_uid").alias("award_id"))
    return cubes.translated_except(awards, t.translation()).withColumnRenamed("label", "description")


@query
def rewards_province(t: Tables) -> DataFrame:
    return t.customer().select(F.col("_uid").alias("customer_id"), postal_district("postal_code").alias("province"))


@query
def rewards_counts(t: Tables) -> DataFrame:
    cube = cubes.reward_cube(*t.reward_tables(), columns=["label", "cycle_type"])
    return reports.rewards_counts(cube, None, *EVERY_DAY)


@query
def rewards_pivot(t: Tables) -> DataFrame:
    cube = cubes.reward_cube(*t.reward_tables(), columns=["label", "cycle_type"])
    return reports.rewards_pivot(cube, REWARD_LABELS, CYCLES, REWARDS_FIRST, REWARDS_LAST)


@query
def rewards_pivot_filtered(t: Tables) -> DataFrame:
    wanted = {"gender": "Building", "age": "All Ages", "hour": "Night"}
    cube = cubes.reward_cube(*t.reward_tables(), columns=["label", "cycle_type", *wanted])
    return reports.rewards_pivot(cube, REWARD_LABELS, CYCLES, REWARDS_FIRST, REWARDS_LAST, wanted)


@query
def event_date_range(t: Tables) -> DataFrame:
    path = files.scratch_path(t.spark, "event-shards")
    events = t.raw("events").select("event_id", "event_type", labels.date_of("ts").alias("event_date"))
    files.write_snapshot(events, path, by="event_date")
    shards = files.read_event_shards(t.spark, path, FIRST, LAST, events.schema)
    return shards.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


@query
def first_opens_distinct(t: Tables) -> DataFrame:
    return cubes.first_open_keys(t.first_open_events())


@query
def first_opens_struct(t: Tables) -> DataFrame:
    return t.first_open_events().select(
        "event_id",
        F.col("device.category").alias("category"),
        F.col("device.operating_system").alias("operating_system"),
        F.col("geo.country").alias("country"),
        F.col("geo.region").alias("region"),
    )


@query
def region_timezone(t: Tables) -> DataFrame:
    events = t.first_open_events()
    local = events.withColumn("local", regions.local_micros("event_timestamp", "geo.region"))
    return local.select(
        "event_id",
        regions.date_of_micros("local").alias("local_date"),
        regions.hour_of_micros("local").alias("local_hour"),
        regions.region_name("geo.region").alias("region"),
        regions.os_name("device.operating_system").alias("os"),
    )


@query
def first_opens_cube(t: Tables) -> DataFrame:
    return cubes.first_opens_cube(*t.event_shards())


@query
def app_by_os(t: Tables) -> DataFrame:
    return reports.app_by_os(cubes.first_opens_cube(*t.event_shards()))


@query
def csv_roundtrip(t: Tables) -> DataFrame:
    customers = t.raw("customer")
    path = files.scratch_path(t.spark, "customers-csv")
    files.write_csv(customers, path)
    return files.read_csv(t.spark, path, customers.schema)


@query
def first_opens_refreshed(t: Tables) -> DataFrame:
    """Two loads: half of the intraday events first, then the final shards of three of those days and the rest."""
    ended, intraday = t.event_shards()
    parts = cubes.first_open_parts(ended)
    store = incremental.DayStore(t.spark, files.scratch_path(t.spark, "first-opens"), parts.schema)
    store.refresh(incremental.settled(ended, intraday.where("event_id % 2 = 0")), cubes.first_open_parts)
    finished = ended.unionByName(intraday.where(F.col("event_date") < F.lit(SETTLED_TO).cast("date")))
    store.refresh(incremental.settled(finished, intraday), cubes.first_open_parts)
    return cubes.first_opens_of_parts(store.read())


@query
def sketch_summary(t: Tables) -> DataFrame:
    sketches = files.materialised(daily.daily_sketches(t.badge_facts()), "daily-sketches")
    return daily.sketched_measures(filters.label_in(sketches, LABELS), FIRST, LAST)


@query
def sketch_tiles(t: Tables) -> DataFrame:
    sketches = files.materialised(daily.daily_sketches(t.order_events()), "daily-sketches")
    return daily.sketched_tiles(sketches, ORDERS_FIRST, ORDERS_LAST)


@query
def period_customers(t: Tables) -> DataFrame:
    sketches = files.materialised(daily.daily_sketches(t.order_events()), "daily-sketches")
    return daily.period_customers(sketches, ORDERS_AS_OF)


@query
def running_orders(t: Tables) -> DataFrame:
    orders = t.raw("orders").select(
        "o_orderkey", labels.date_of("o_orderdate").alias("date"), F.floor("o_totalprice").alias("amount")
    )
    return prefix.running_sum(orders, ["date", "o_orderkey"], "amount")


@query
def running_customer_shares(t: Tables) -> DataFrame:
    counts = t.order_events().groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    running = prefix.running_sum(counts, [F.desc("n"), "customer_id"], "n")
    whole = counts.agg(F.sum("n")).scalar()
    return running.select(
        "customer_id", "n", numbers.percent_of("n", whole).alias("share"), numbers.percent_of("running", whole).alias("cum_share")
    )


@query
def order_positions(t: Tables) -> DataFrame:
    orders = t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return prefix.positions(orders, [F.desc("o_totalprice"), "o_orderkey"])


@query
def period_sums_prefix(t: Tables) -> DataFrame:
    return daily.period_sums(files.materialised(daily.cumulative(t.order_events()), "cumulative"), ORDERS_AS_OF)


@query
def kpi_growth_prefix(t: Tables) -> DataFrame:
    return daily.growth_sums(files.materialised(daily.cumulative(t.order_events()), "cumulative"), ORDERS_FIRST, ORDERS_LAST)


@query
def page_deep(t: Tables) -> DataFrame:
    orders = t.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    pages = prefix.write_pages(orders, [F.desc("o_totalprice"), "o_orderkey"], files.scratch_path(t.spark, "pages"))
    return pages.page(*DEEP_PAGE)


@query
def bitmap_pairs(t: Tables) -> DataFrame:
    index = files.materialised(bitmaps.dimension_bitmaps(t.badge_facts(), BITMAP_DIMENSIONS), "bitmaps")
    return bitmaps.pair_customers(index, "gender", "age")


@query
def bitmap_filter(t: Tables) -> DataFrame:
    index = files.materialised(bitmaps.dimension_bitmaps(t.badge_facts(), BITMAP_DIMENSIONS), "bitmaps")
    return bitmaps.combination_customers(index, BITMAP_WANTED)


@query
def label_lists(t: Tables) -> DataFrame:
    return label_lists_of.every_list(t.badge_facts(), [*LABELS, "signup"], FIRST, LAST)


@query
def label_list_summaries(t: Tables) -> DataFrame:
    return label_lists_of.list_summaries(t.order_events(), PRIORITY_LISTS, ORDERS_FIRST, ORDERS_LAST)


@query
def csv_line_breaks(t: Tables) -> DataFrame:
    text = F.concat_ws("\n", "c_name", F.concat(F.lit('says "'), F.col("c_mktsegment"), F.lit('",')), F.lit(""), "c_mktsegment")
    customers = t.raw("customer").select("c_custkey", text.alias("note"), "c_acctbal")
    path = files.scratch_path(t.spark, "notes-csv")
    files.write_csv(customers, path, multi_line=True)
    return csv_split.read_csv_lines(t.spark, path, customers.schema)


@query
def csv_inferred(t: Tables) -> DataFrame:
    orders = t.raw("orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_totalprice",
        labels.date_of("o_orderdate").alias("day"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        "o_orderpriority",
    )
    path = files.scratch_path(t.spark, "orders-csv")
    files.write_csv(orders, path)
    return files.read_csv(t.spark, path, csv_split.infer_schema(t.spark, path))
