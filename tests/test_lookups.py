"""The lookup tables against values written down here once more, and reports called by period and label list."""

import datetime as dt

from helpers import tuples
from pyspark.sql import functions as F

from badgewright import fixed
from badgewright.functions.regions import region_name
from badgewright.plans import reports
from badgewright.sources.lookups import postal_district, provinces

PROVINCES = """A NL Newfoundland & Labrador|B NS Nova Scotia|C PE Prince Edward Island|E NB New Brunswick|G QC Québec
H QC Québec|J QC Québec|K ON Ontario|L ON Ontario|M ON Ontario|N ON Ontario|P ON Ontario|R MB Manitoba|S SK Saskatchewan
T AB Alberta|V BC British Columbia|X NT/NU NW Territories & Nunavut|Y YT Yukon Territory"""
DISTRICTS = """A Newfoundland and Labrador|B Nova Scotia|C Prince Edward Island|E New Brunswick|G Eastern Quebec
H Metropolitan Montréal|J Western Quebec|K Eastern Ontario|L Central Ontario|M Metropolitan Toronto
N Southwestern Ontario|P Northern Ontario|R Manitoba|S Saskatchewan|T Alberta|V British Columbia
X Northwest Territories and Nunavut|Y Yukon"""
PERIOD_CODES = "y yp q qp m mp w wp 90 30 14 7".split()


def lines(text, parts):
    return [tuple(x.split(" ", parts - 1)) for x in text.replace("\n", "|").split("|")]


def test_provinces(spark):
    assert sorted(tuples(provinces(spark))) == lines(PROVINCES, 3)


def test_postal_districts(spark):
    codes = spark.createDataFrame([(i + "1A 1A1",) for i, _ in lines(DISTRICTS, 2)] + [("D1A",), (None,)], "code string")
    found = dict(tuples(codes.select("code", postal_district("code").alias("d"))))
    assert found == {i + "1A 1A1": d for i, d in lines(DISTRICTS, 2)} | {"D1A": None, None: None}


def test_region_names_and_period_codes(spark):
    names = {"Quebec": "Québec", "Nunavut": "NW Territories & Nunavut", "Ontario": "Ontario"}
    names |= {"Newfoundland and Labrador": "Newfoundland & Labrador", "Northwest Territories": "NW Territories & Nunavut"}
    regions = spark.createDataFrame([(x,) for x in names], "region string")
    assert dict(tuples(regions.select("region", region_name("region").alias("n")))) == names
    assert list(fixed.PERIODS.values()) == PERIOD_CODES


def test_report_for_a_period_and_a_label_list(spark):
    day = dt.date(2019, 3, 15)
    rows = [(1, "Weekly", dt.date(2019, 3, 2), 2), (2, "4-Week Streak", dt.date(2019, 2, 20), 1), (1, "Opened App", dt.date(2019, 3, 3), 5)]
    fact = spark.createDataFrame(rows, "customer_id int, label string, date date, count long")
    as_of = F.lit(day)
    this_month = reports.for_period(reports.badge_summary, fact, "m", "activity", as_of)
    assert tuples(this_month, "ord", "label", "total") == [(1, "Weekly", 2)]
    last_30 = reports.for_period(reports.badge_summary, fact, "30", "activity", as_of)
    assert tuples(last_30, "label", "total") == [("Weekly", 2), ("4-Week Streak", 1)]
    assert tuples(reports.for_period(reports.daily_series, fact, "mp", as_of=as_of)) == [(dt.date(2019, 2, 20), 1)]
