"""The facts: badge cube, reward ballots, first opens.

Tables are expected with their own column names (``_uid`` is a table's primary
key). Facts are counted before they meet the customers, so that what is shuffled
by customer is the cube, not its raw rows.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from badgewright.functions.dayparts import app_day_part, badge_day_part, reward_day_part
from badgewright.functions.labels import (
    age_band,
    capitalised,
    date_of,
    is_milestone,
    leading_minutes,
    month_label,
    postal_initial,
    quarter_label,
    weekday_name,
    weekly_label,
)
from badgewright.functions.regions import date_of_micros, hour_of_micros, local_micros, os_name, region_name
from badgewright.operators.joins import counted_rows, enrich, join_many
from badgewright.sources.lookups import postal_district, with_province


def translated(translation: DataFrame, language: str = "en") -> DataFrame:
    """Badge texts of one language: (award_id, label)."""
    return translation.where(F.col("language_code") == language).select(
        F.col("master_id").alias("award_id"), F.col("short_description").alias("label")
    )


def badges(award: DataFrame, translation: DataFrame) -> DataFrame:
    """Award code and English text of every award: (award_id, award_code, label)."""
    codes = award.select(F.col("_uid").alias("award_id"), "award_code")
    return codes.join(translated(translation), "award_id")


def customer_labels(customer: DataFrame) -> DataFrame:
    """The dimensions of a customer, labelled once per customer instead of once per badge."""
    return customer.select(
        F.col("_uid").alias("customer_id"),
        "appuser_id",
        "user_selected_level",
        capitalised("gender").alias("gender"),
        age_band("age").alias("age"),
        postal_initial("postal_code").alias("province_postcode"),
    )


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"quarter": quarter_label(date), "month": month_label(date)})


def badges_per_day(
    customer_award: DataFrame,
    award: DataFrame,
    translation: DataFrame,
    badge: Sequence[str] = ("award_code", "label"),
    parts: bool = True,
) -> DataFrame:
    """Badges counted per customer, badge (the columns of ``badge``), day and (if wanted) day part."""
    earned = customer_award.select(
        "_uid",
        "customer_id",
        "award_id",
        date_of("created_at").alias("date"),
        badge_day_part(F.hour("created_at")).alias("hour"),
    )
    named = enrich(earned, badges(award, translation), "award_id", spread=["_uid"])
    return named.groupBy("customer_id", *badge, "date", *["hour"] * parts).agg(F.count("label").alias("count"))


def badge_cube(
    customer_award: DataFrame,
    award: DataFrame,
    translation: DataFrame,
    customer: DataFrame,
    keep_unreached: bool = False,
) -> DataFrame:
    """Badges per customer, badge, day and day part, with the customer's dimensions.

    Customers who never reached a milestone have no ``max_award_code`` and are
    left out; ``keep_unreached`` keeps them.
    """
    top = milestone_top(customer_award, award, translation)
    people = customer_labels(customer).join(top, "customer_id", "left" if keep_unreached else "inner")
    counted = with_calendar(badges_per_day(customer_award, award, translation))
    return enrich(counted, people, "customer_id", count_from=customer_award)


def badge_cube_with_answers(
    customer_award: DataFrame,
    award: DataFrame,
    translation: DataFrame,
    customer: DataFrame,
    answer: DataFrame,
) -> DataFrame:
    """The older cube: without award codes, with the customer's onboarding answer."""
    counted = badges_per_day(customer_award, award, translation, badge=["label"])
    given = given_answers(answer)
    answers = given.groupBy(*given.columns).agg(F.count(F.lit(1)).alias("times"))
    people = customer_labels(customer).drop("user_selected_level")
    people = enrich(people, answers, "appuser_id", "left", spread=["customer_id"])
    cube = enrich(counted, people, "customer_id", count_from=customer_award)
    times = F.coalesce("times", F.lit(1))
    return with_calendar(cube.withColumn("count", F.col("count") * times).drop("times"))


def given_answers(answer: DataFrame) -> DataFrame:
    """Answers to the onboarding question: (appuser_id, answer)."""
    return answer.where((F.col("type") == "onboarding") & (F.col("questionKey") == "activityLevel")).select(
        F.col("userId").alias("appuser_id"), F.col("answerValue").alias("answer")
    )


def onboarding_answer(customer: DataFrame, answer: DataFrame) -> DataFrame:
    """Customers with their answer to the onboarding question, NULL if they gave none."""
    return join_many(customer, given_answers(answer), "appuser_id")


def with_badge_province(cube: DataFrame) -> DataFrame:
    """The cube as reported: weekly badge renamed, province looked up."""
    return with_province(cube.withColumn("label", weekly_label("label")))


def milestones(translation: DataFrame) -> DataFrame:
    """Minutes of every milestone badge: (award_id, minutes)."""
    return (
        translated(translation)
        .where(is_milestone("label"))
        .select("award_id", leading_minutes("label").alias("minutes"))
    )


def milestone_codes(award: DataFrame, translation: DataFrame) -> DataFrame:
    """Every award code with the minutes it stands for."""
    codes = award.select(F.col("_uid").alias("award_id"), "award_code")
    return codes.join(milestones(translation), "award_id").select("award_code", "minutes").distinct()


def best_minutes(customer_award: DataFrame, translation: DataFrame) -> DataFrame:
    """The most minutes of a milestone each customer earned: (customer_id, minutes)."""
    earned = customer_award.select("_uid", "customer_id", "award_id")
    reached = enrich(earned, milestones(translation), "award_id", spread=["_uid"])
    return reached.groupBy("customer_id").agg(F.max("minutes").alias("minutes"))


def cube_times(customer_award: DataFrame, award: DataFrame, translation: DataFrame) -> DataFrame:
    """How often a customer's rows stand in the badge cube: (customer_id, times), once per code of the top milestone."""
    codes = milestone_codes(award, translation).groupBy("minutes").agg(F.count(F.lit(1)).alias("times"))
    return enrich(best_minutes(customer_award, translation), codes, "minutes").select("customer_id", "times")


def badge_cube_sums(
    customer_award: DataFrame, award: DataFrame, translation: DataFrame, customer: DataFrame
) -> DataFrame:
    """The badge cube without award codes and dimensions: customer_id, label, date, count.

    The codes that stand for a customer's top milestone multiply the counts; no row is multiplied.
    """
    people = enrich(customer.select(F.col("_uid").alias("customer_id")), cube_times(customer_award, award, translation), "customer_id")
    counted = badges_per_day(customer_award, award, translation, badge=["label"], parts=False)
    sums = enrich(counted, people, "customer_id", count_from=customer_award)
    return sums.select("customer_id", "label", "date", (F.col("count") * F.col("times")).alias("count"))


def badge_provinces(
    customer_award: DataFrame, award: DataFrame, translation: DataFrame, customer: DataFrame
) -> DataFrame:
    """Rows and badges of the reported cube per province, label and quarter, the customers' provinces looked up once."""
    times = cube_times(customer_award, award, translation)
    people = customer.select(F.col("_uid").alias("customer_id"), postal_initial("postal_code").alias("province_postcode"))
    people = enrich(people, times, "customer_id")
    days = badges_per_day(customer_award, award, translation)
    cube = enrich(days, people, "customer_id", count_from=customer_award)
    labels = weekly_label("label").alias("label"), quarter_label("date").alias("quarter")
    sums = cube.groupBy("province_postcode", *labels).agg(
        F.sum("times").alias("n_rows"), F.sum(F.col("count") * F.col("times")).alias("count")
    )
    return with_province(sums)


def milestone_top(customer_award: DataFrame, award: DataFrame, translation: DataFrame) -> DataFrame:
    """The highest milestone of each customer, as award code.

    A customer appears once for every code that stands for the same minutes, and
    not at all without a milestone.
    """
    best = best_minutes(customer_award, translation)
    codes = milestone_codes(award, translation).withColumnRenamed("award_code", "max_award_code")
    return enrich(best, codes, "minutes").select("customer_id", "max_award_code")


def translated_except(
    df: DataFrame, translation: DataFrame, language: str = "fr", count_from: DataFrame | None = None
) -> DataFrame:
    """Left join with the texts of all languages but one, by ``award_id``.

    The language condition belongs to the join: an award with texts in that
    language only (or in none) stays, without a text.
    """
    texts = translation.where(F.col("language_code") != language).select(
        F.col("master_id").alias("award_id"), "language_code", F.col("short_description").alias("label")
    )
    return enrich(df, texts, "award_id", "left", count_from=count_from)


REWARD_AWARD = {"num_ballots"}
REWARD_CUSTOMER = {"user_selected_level", "gender", "age", "age_years", "postal_code", "province"}
REWARD_CYCLE = {"cycle_type"}


def reward_sides(
    cycle_instance: DataFrame,
    cycle: DataFrame,
    customer_award: DataFrame,
    award: DataFrame,
    customer: DataFrame,
    translation: DataFrame,
    columns: Collection[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The two sides of a ballot: its cycle, and its customer award with all that hangs on it.

    The award, customer and text are joined to the customer award, not to the
    ballots, of which there are many more. Left joins on a primary key change no
    row, so those that give none of the wanted ``columns`` are left out. The text
    is always joined where it counts: several languages make several rows.
    """

    def wanted(group: Collection[str]) -> bool:
        return columns is None or bool(set(group) & set(columns))

    cycles = cycle_instance.select(F.col("_uid").alias("reward_cycle_instance_id"), "reward_cycle_id")
    if wanted(REWARD_CYCLE):
        types = cycle.select(F.col("_uid").alias("reward_cycle_id"), "cycle_type")
        cycles = enrich(cycles, types, "reward_cycle_id", "left")
    cycles = cycles.drop("reward_cycle_id")

    awards = customer_award.select(F.col("_uid").alias("customer_award_id"), "customer_id", "award_id")
    award_ids = awards
    if wanted(REWARD_CUSTOMER):
        people = customer.select(
            F.col("_uid").alias("customer_id"),
            "user_selected_level",
            capitalised("gender").alias("gender"),
            age_band("age").alias("age"),
            F.col("age").alias("age_years"),
            "postal_code",
            postal_district("postal_code").alias("province"),
        )
        awards = enrich(awards, people, "customer_id", "left")
    if wanted(REWARD_AWARD):
        ballots = award.select(F.col("_uid").alias("award_id"), "num_ballots")
        awards = enrich(awards, ballots, "award_id", "left", count_from=award_ids)
    awards = translated_except(awards, translation, count_from=award_ids).drop("award_id", "language_code")
    return cycles, awards


def rewards_fact(
    ballot: DataFrame,
    cycle_instance: DataFrame,
    cycle: DataFrame,
    customer_award: DataFrame,
    award: DataFrame,
    customer: DataFrame,
    translation: DataFrame,
) -> DataFrame:
    """One row per ballot and text, with cycle, customer and calendar labels."""
    cycles, awards = reward_sides(cycle_instance, cycle, customer_award, award, customer, translation)
    fact = ballot.select("_uid", "customer_award_id", "reward_cycle_instance_id", "created_at")
    fact = enrich(fact, cycles, "reward_cycle_instance_id", "left", spread=["_uid"])
    fact = enrich(fact, awards, "customer_award_id", "left", spread=["_uid"], count_from=ballot)
    fact = fact.withColumns(
        {
            "date": date_of("created_at"),
            "hour": reward_day_part(F.hour("created_at")),
            "count": F.lit(1).cast("bigint"),
        }
    )
    fact = with_calendar(fact).withColumn("day", weekday_name("date"))
    return fact.drop("_uid", "customer_award_id", "reward_cycle_instance_id")


def reward_cube(
    ballot: DataFrame,
    cycle_instance: DataFrame,
    cycle: DataFrame,
    customer_award: DataFrame,
    award: DataFrame,
    customer: DataFrame,
    translation: DataFrame,
    columns: Collection[str] | None = None,
) -> DataFrame:
    """The rewards fact with equal ballots counted before the joins.

    ``columns`` names what the report needs beside ``date``, ``hour`` and ``count``
    (the calendar labels come with the date).
    """
    cycles, awards = reward_sides(cycle_instance, cycle, customer_award, award, customer, translation, columns)
    counted = counted_rows(
        ballot.select(
            "customer_award_id",
            "reward_cycle_instance_id",
            date_of("created_at").alias("date"),
            reward_day_part(F.hour("created_at")).alias("hour"),
        )
    )
    fact = enrich(counted, cycles, "reward_cycle_instance_id", "left", count_from=ballot)
    fact = enrich(fact, awards, "customer_award_id", "left", count_from=ballot)
    fact = with_calendar(fact).withColumn("day", weekday_name("date"))
    return fact.drop("customer_award_id", "reward_cycle_instance_id")


def first_open_rows(events: DataFrame, country: str = "Canada") -> DataFrame:
    return events.where((F.col("event_name") == "first_open") & (F.col("geo.country") == country))


def first_open_keys(events: DataFrame) -> DataFrame:
    """Distinct first opens with their device and place, day part by the UTC hour."""
    return (
        events.where(F.col("event_name") == "first_open")
        .select(
            "user_pseudo_id",
            "event_date",
            "event_timestamp",
            badge_day_part(hour_of_micros("event_timestamp")).alias("hour"),
            "event_name",
            F.col("device.category").alias("category"),
            F.col("device.operating_system").alias("operating_system"),
            F.col("geo.country").alias("country"),
            F.col("geo.region").alias("region"),
        )
        .distinct()
    )


def first_opens_cube(
    daily: DataFrame, intraday: DataFrame, corrected: bool = False, country: str = "Canada"
) -> DataFrame:
    """First opens per local day, device category, system, day part and region.

    Daily and intraday events are counted apart: a group that both have appears
    twice. The shard is a grouping column, so one aggregation serves both.
    """
    shards = first_open_rows(daily, country).withColumn("shard", F.lit("daily")).unionByName(
        first_open_rows(intraday, country).withColumn("shard", F.lit("intraday"))
    )
    local = shards.select("shard", "device", "geo", local_micros("event_timestamp", "geo.region").alias("local"))
    hour: Column = hour_of_micros("local")
    return (
        local.groupBy(
            "shard",
            date_of_micros("local").alias("date"),
            F.col("device.category").alias("category"),
            os_name("device.operating_system").alias("operating_system"),
            app_day_part(hour, corrected).alias("time"),
            region_name("geo.region").alias("region"),
        )
        .agg(F.count(F.lit(1)).alias("first_open"))
        .drop("shard")
        .orderBy("date")
    )


def first_open_parts(events: DataFrame, corrected: bool = False, country: str = "Canada") -> DataFrame:
    """First opens per shard day and the labels of the cube: what a load keeps of a day's shard.

    The local day may lie before the shard's, so one local day can have parts in two shards.
    """
    opens = first_open_rows(events, country)
    local = opens.select("event_date", "device", "geo", local_micros("event_timestamp", "geo.region").alias("local"))
    return local.groupBy(
        "event_date",
        date_of_micros("local").alias("date"),
        F.col("device.category").alias("category"),
        os_name("device.operating_system").alias("operating_system"),
        app_day_part(hour_of_micros("local"), corrected).alias("time"),
        region_name("geo.region").alias("region"),
    ).agg(F.count(F.lit(1)).alias("first_open"))


def first_opens_of_parts(parts: DataFrame) -> DataFrame:
    """The cube from the parts of all shard days; a group has one row, whichever shards it comes from."""
    keys = ["date", "category", "operating_system", "time", "region"]
    return parts.groupBy(*keys).agg(F.sum("first_open").alias("first_open"))
