"""The driver's tables in the shape of the programme's tables.

Remainders (``%``) here give the test data the cases the programme has: awards
with no text, with French only, with several languages; a few minutes with two codes; customer
awards of no award (NULL key); ballots of no cycle (NULL key). Every row of every table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from badgewright.functions.dayparts import badge_day_part
from badgewright.functions.labels import age_band, date_of, month_label, postal_initial, quarter_label
from badgewright.functions.regions import epoch_micros
from badgewright.operators.joins import counted_rows, enrich
from badgewright.sources.lookups import province_name

# Regions of the mobile events, by nation.
REGIONS = [
    "Ontario",
    "Quebec",
    "Nunavut",
    "Manitoba",
    "Saskatchewan",
    "Northwest Territories",
    "Alberta",
    "British Columbia",
    "Yukon Territory",
    "Newfoundland and Labrador",
    "Nova Scotia",
    "New Brunswick",
    "Prince Edward Island",
    None,
]

INTRADAY_FROM = "2024-01-25"


class Tables:
    """Programme tables derived from the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._schemas: dict[str, T.StructType] = {}

    def raw(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def customer(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS _uid",
            "c_custkey AS appuser_id",
            "c_nationkey % 5 AS user_selected_level",
            "c_mktsegment AS gender",
            "CAST(nullif((c_custkey * 7) % 90, 0) AS INT) AS age",
            "concat(chr(65 + c_nationkey), '1A') AS postal_code",
            "c_nationkey",
        )

    def customer_award(self) -> DataFrame:
        line = self.raw("lineitem").select(
            F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("_uid"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("award_id"),
            F.col("l_shipdate").alias("created_at"),
        )
        order = self.raw("orders").selectExpr("o_orderkey AS order_id", "o_custkey AS customer_id")
        return enrich(line, order, "order_id", spread=["_uid"]).drop("order_id")

    def award(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS _uid",
            "concat('A', p_size, CASE WHEN p_size % 10 = 0 AND p_partkey % 2 = 0 THEN 'x' ELSE '' END) AS award_code",
            "p_size % 10 AS num_ballots",
        )

    def translation(self) -> DataFrame:
        texts = "array(named_struct('l', 'en', 'p', '', 'is', p_size % 7 <> 0),"
        texts += " named_struct('l', 'fr', 'p', 'fr ', 'is', p_size % 2 = 0),"
        texts += " named_struct('l', 'es', 'p', 'es ', 'is', p_size % 5 = 0))"
        part = self.raw("part").selectExpr(
            "p_partkey AS master_id",
            "CASE WHEN p_type = 'PROMO' THEN p_size || ' Minutes Milestone' ELSE p_name END AS text",
            f"inline({texts})",
        )
        return part.where("is").selectExpr("master_id", "l AS language_code", "p || text AS short_description")

    def answer(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS userId",
            "CASE WHEN c_custkey % 2 = 0 THEN 'onboarding' ELSE 'weekly' END AS type",
            "CASE WHEN c_custkey % 3 = 0 THEN 'activityLevel' ELSE 'goal' END AS questionKey",
            "c_mktsegment AS answerValue",
        )

    def ballot(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS _uid",
            "l_orderkey AS customer_award_id",
            "nullif(l_suppkey, 0L) AS reward_cycle_instance_id",
            "l_shipdate AS created_at",
        )

    def cycle_instance(self) -> DataFrame:
        return self.raw("supplier").selectExpr("s_suppkey AS _uid", "nullif(s_nationkey, 24) AS reward_cycle_id")

    def cycle(self) -> DataFrame:
        region = self.raw("region").selectExpr("r_regionkey AS n_regionkey", "r_name AS cycle_type")
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        return enrich(nation, region, "n_regionkey").selectExpr("n_nationkey AS _uid", "cycle_type")

    def reward_award(self) -> DataFrame:
        """Customer awards that ballots belong to, over all awards; every eleventh is of none."""
        order, awards = F.col("o_orderkey"), self.raw("part").agg(F.max("p_partkey") + 1).scalar()
        return self.raw("orders").select(
            order.alias("_uid"),
            F.col("o_custkey").alias("customer_id"),
            F.when(order % 11 != 0, order % awards).alias("award_id"),
        )

    def reward_tables(self) -> tuple[DataFrame, ...]:
        return (
            self.ballot(),
            self.cycle_instance(),
            self.cycle(),
            self.reward_award(),
            self.award(),
            self.customer(),
            self.translation(),
        )

    def badge_tables(self) -> tuple[DataFrame, ...]:
        return self.customer_award(), self.award(), self.translation(), self.customer()

    def badge_events(self) -> DataFrame:
        """One row per event, with the customer's raw columns."""
        events = self.raw("events").selectExpr(
            "event_id",
            "user_id AS customer_id",
            "upper(substring(event_type, 1, 1)) AS award_code",
            "event_type AS label",
            "ts AS created_at",
            "CAST(ts AS DATE) AS date",
            "1L AS count",
        )
        people = self.customer().withColumnRenamed("_uid", "customer_id")
        return enrich(events, people, "customer_id", spread=["event_id"])

    def badge_facts(self) -> DataFrame:
        """The events counted per customer, label, day and day part, with labelled dimensions."""
        events = self.raw("events").select(
            F.col("user_id").alias("customer_id"),
            F.col("event_type").alias("label"),
            date_of("ts").alias("date"),
            badge_day_part(F.hour("ts")).alias("hour"),
        )
        initial = postal_initial("postal_code")
        people = self.customer().select(
            F.col("_uid").alias("customer_id"),
            "user_selected_level",
            "gender",
            age_band("age").alias("age"),
            initial.alias("province_postcode"),
            province_name(initial).alias("province"),
        )
        fact = enrich(counted_rows(events), people, "customer_id", count_from=events)
        return fact.withColumns({"quarter": quarter_label("date"), "month": month_label("date")})

    def order_events(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_custkey AS customer_id",
            "CAST(o_orderdate AS DATE) AS date",
            "o_orderpriority AS label",
            "1L AS count",
        )

    def first_open_events(self) -> DataFrame:
        """Mobile events with nested device and place."""
        events = self.raw("events").select(
            "event_id",
            F.col("user_id").alias("customer_id"),
            epoch_micros("ts").alias("event_timestamp"),
            date_of("ts").alias("event_date"),
            F.when(F.col("event_type") == "signup", "first_open").otherwise(F.col("event_type")).alias("event_name"),
        )
        people = self.customer().select(F.col("_uid").alias("customer_id"), "gender", "c_nationkey")
        regions = F.array(*[F.lit(r).cast("string") for r in REGIONS])
        return enrich(events, people, "customer_id", spread=["event_id"]).select(
            "event_id",
            F.col("customer_id").alias("user_pseudo_id"),
            "event_date",
            "event_timestamp",
            "event_name",
            F.struct(
                F.col("gender").alias("category"),
                F.expr("CASE event_id % 3 WHEN 0 THEN 'ANDROID' WHEN 1 THEN 'IOS' END").alias("operating_system"),
            ).alias("device"),
            F.struct(
                F.when(F.col("c_nationkey") % 5 == 4, "United States").otherwise("Canada").alias("country"),
                F.element_at(regions, F.col("c_nationkey") % 14 + 1).alias("region"),
            ).alias("geo"),
        )

    def event_shards(self) -> tuple[DataFrame, DataFrame]:
        """Mobile events of the finished days, and of the days from ``INTRADAY_FROM`` on."""
        events = self.first_open_events()
        intraday = F.col("event_date") >= F.lit(INTRADAY_FROM).cast("date")
        return events.where(~intraday), events.where(intraday)
