import datetime as dt
from collections import Counter

import pytest
from helpers import column, tuples

from badgewright.plans import cubes, reports
from badgewright.sources.lookups import provinces

D, T = dt.date, dt.datetime


@pytest.fixture
def tables(spark):
    award = spark.createDataFrame(
        [(1, "M50", 2), (2, "M90", 3), (3, "OPEN", 0), (4, "M50B", 1), (5, "NOTEXT", 7)],
        "_uid long, award_code string, num_ballots int",
    )
    translation = spark.createDataFrame(
        [
            (1, "en", "50 Minutes Milestone"),
            (1, "fr", "Jalon 50"),
            (2, "en", "90 Minutes milestone"),
            (2, "es", "90 minutos"),
            (3, "fr", "Ouverte"),
            (3, "en", "Opened App"),
            (4, "en", "50 Minute Milestone"),
            (5, None, "no language"),
            (5, "fr", "Sans"),
        ],
        "master_id long, language_code string, short_description string",
    )
    customer = spark.createDataFrame(
        [(10, 110, 3, "m5v", "fEMALE", 30), (11, 111, 4, "D1A", "MALE", None), (12, 112, 0, None, None, 4)],
        "_uid long, appuser_id long, user_selected_level int, postal_code string, gender string, age int",
    )
    rows = [
        (10, 1, T(2019, 2, 28, 7)),
        (10, 1, T(2019, 2, 28, 11)),
        (10, 1, T(2019, 2, 28, 12)),
        (10, 2, T(2019, 3, 1, 23)),
        (11, 3, T(2019, 3, 1, 0)),
        (11, 1, T(2019, 3, 2, 18)),
        (12, 3, T(2019, 3, 2, 6)),
        (12, 5, T(2019, 3, 2, 6)),
        (99, 1, T(2019, 3, 2, 6)),
    ]
    customer_award = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "_uid long, customer_id long, award_id long, created_at timestamp_ntz"
    )
    return customer_award, award, translation, customer


CUBE = ["customer_id", "award_code", "max_award_code", "date", "hour", "count"]
F28, M1, M2 = D(2019, 2, 28), D(2019, 3, 1), D(2019, 3, 2)
EXPECTED = [
    (10, "M50", "M90", F28, "Morning", 2),
    (10, "M50", "M90", F28, "Afternoon", 1),
    (10, "M90", "M90", M1, "Evening", 1),
    # Two codes stand for 50 minutes: customer 11 appears with both.
    (11, "OPEN", "M50", M1, "Night", 1),
    (11, "OPEN", "M50B", M1, "Night", 1),
    (11, "M50", "M50", M2, "Evening", 1),
    (11, "M50", "M50B", M2, "Evening", 1),
]


def test_badge_cube(tables):
    cube = cubes.badge_cube(*tables)
    assert Counter(tuples(cube, *CUBE)) == Counter(EXPECTED)
    labels = set(tuples(cube.where("customer_id = 10 and count = 2"), "label", "gender", "age", "quarter", "month"))
    assert labels == {("50 Minutes Milestone", "Female", "25-34", "Q1 2019", "Feb 2019")}
    assert set(column(cube.where("customer_id = 11"), "age")) == {"65+"}


def test_badge_cube_with_salted_joins(tables, no_broadcast, settings):
    settings(spark__badgewright__hotKey__rowsPerTask="1")
    assert Counter(tuples(cubes.badge_cube(*tables), *CUBE)) == Counter(EXPECTED)


def test_badge_cube_can_keep_customers_without_a_milestone(tables):
    cube = cubes.badge_cube(*tables, keep_unreached=True)
    added = Counter(tuples(cube, *CUBE)) - Counter(EXPECTED)
    assert added == Counter([(12, "OPEN", None, M2, "Morning", 1)])


def test_badge_province(spark, tables):
    cube = cubes.with_badge_province(cubes.badge_cube(*tables))
    got = set(tuples(cube, "customer_id", "province_postcode", "province_code", "province"))
    assert got == {(10, "M", "ON", "Ontario"), (11, "D", None, None)}
    weekly = spark.sql("SELECT 'Weekly Challenge Complete' AS label, 'V' AS province_postcode")
    assert tuples(cubes.with_badge_province(weekly), "label", "province") == [("Weekly", "British Columbia")]
    assert provinces(spark).count() == 18


def test_milestones(tables):
    customer_award, award, translation, _ = tables
    assert set(tuples(cubes.milestone_codes(award, translation))) == {("M50", 50), ("M50B", 50), ("M90", 90)}
    top = Counter(tuples(cubes.milestone_top(customer_award, award, translation)))
    assert top == Counter([(10, "M90"), (11, "M50"), (11, "M50B"), (99, "M50"), (99, "M50B")])


@pytest.fixture
def answers(spark):
    return spark.createDataFrame(
        [
            (110, "onboarding", "activityLevel", "high"),
            (110, "weekly", "activityLevel", "low"),
            (111, "onboarding", "goal", "run"),
            (112, "onboarding", "activityLevel", "mid"),
            (112, "onboarding", "activityLevel", "mid"),
        ],
        "userId long, type string, questionKey string, answerValue string",
    )


def test_onboarding_answers(tables, answers):
    got = Counter(tuples(cubes.onboarding_answer(tables[3], answers), "_uid", "answer"))
    assert got == Counter({(10, "high"): 1, (11, None): 1, (12, "mid"): 2})


def test_older_cube_counts_every_answer(tables, answers):
    cube = cubes.badge_cube_with_answers(*tables, answers)
    assert Counter(tuples(cube, "customer_id", "label", "answer", "date", "count")) == Counter(
        [
            (10, "50 Minutes Milestone", "high", F28, 2),
            (10, "50 Minutes Milestone", "high", F28, 1),
            (10, "90 Minutes milestone", "high", M1, 1),
            (11, "Opened App", None, M1, 1),
            (11, "50 Minutes Milestone", None, M2, 1),
            (12, "Opened App", "mid", M2, 2),
        ]
    )


def test_left_join_with_a_language_condition(spark, tables):
    awards = spark.createDataFrame([(1,), (2,), (3,), (5,), (6,)], "award_id long").selectExpr("award_id", "0 AS x")
    got = Counter(tuples(cubes.translated_except(awards, tables[2]), "award_id", "language_code"))
    assert got == Counter([(1, "en"), (2, "en"), (2, "es"), (3, "en"), (5, None), (6, None)])


@pytest.fixture
def rewards(spark, tables):
    _, award, translation, customer = tables
    ballot = spark.createDataFrame(
        [
            (1, 100, 1000, T(2019, 2, 28, 17)),
            (2, 100, 1000, T(2019, 2, 28, 17)),
            (3, 100, None, T(2019, 3, 1, 5)),
            (4, 101, 1001, T(2019, 3, 1, 12)),
            (5, 999, 1000, T(2019, 3, 1, 22)),
            (6, None, 1002, None),
            (7, 102, 1000, T(2019, 3, 1, 6)),
        ],
        "_uid long, customer_award_id long, reward_cycle_instance_id long, created_at timestamp_ntz",
    )
    instance = spark.createDataFrame([(1000, 1), (1001, 2), (1002, 7)], "_uid long, reward_cycle_id long")
    cycle = spark.createDataFrame([(1, "daily"), (2, "grand")], "_uid long, cycle_type string")
    earned = spark.createDataFrame(
        [(100, 10, 2), (101, 11, 3), (102, 98, None)], "_uid long, customer_id long, award_id long"
    )
    return ballot, instance, cycle, earned, award, customer, translation


REWARDS = Counter(
    {
        (10, "90 Minutes milestone", "daily", 3, "25-34", "Evening", "Thursday"): 2,
        (10, "90 minutos", "daily", 3, "25-34", "Evening", "Thursday"): 2,
        (10, "90 Minutes milestone", None, 3, "25-34", "Night", "Friday"): 1,
        (10, "90 minutos", None, 3, "25-34", "Night", "Friday"): 1,
        (11, "Opened App", "grand", 0, "65+", "Afternoon", "Friday"): 1,
        (None, None, "daily", None, None, "Night", "Friday"): 1,
        (None, None, None, None, None, None, None): 1,
        (98, None, "daily", None, None, "Morning", "Friday"): 1,
    }
)
REWARD_COLUMNS = ["customer_id", "label", "cycle_type", "num_ballots", "age", "hour", "day"]


@pytest.mark.parametrize("large", [False, True])
def test_rewards_fact(rewards, settings, large):
    if large:
        settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__badgewright__hotKey__rowsPerTask="1")
    fact = cubes.rewards_fact(*rewards)
    assert Counter(tuples(fact, *REWARD_COLUMNS)) == REWARDS
    assert set(column(fact.where("customer_id = 10"), "province")) == {"Metropolitan Toronto"}
    cube = cubes.reward_cube(*rewards).groupBy(*REWARD_COLUMNS).sum("count")
    assert Counter({tuple(r)[:-1]: r[-1] for r in cube.collect()}) == REWARDS


def test_rewards_reports(rewards):
    cube = cubes.reward_cube(*rewards, columns=["label", "cycle_type"])
    assert "num_ballots" not in cube.columns and "gender" not in cube.columns
    labels = ["90 Minutes milestone", "Opened App", "None"]
    counts = reports.rewards_counts(cube, labels, "2019-02-01", "2019-03-31")
    assert tuples(counts) == [
        ("90 Minutes milestone", "daily", 2),
        ("90 Minutes milestone", None, 1),
        ("Opened App", "grand", 1),
    ]
    pivot = reports.rewards_pivot(cube, labels, ["daily", "grand", "<NA>"], "2019-02-01", "2019-03-31")
    assert tuples(pivot) == [("90 Minutes milestone", 2, None, 1, None), ("Opened App", None, 1, None, None)]


EVENT = """user_pseudo_id string, event_date date, event_timestamp long, event_name string,
    device struct<category: string, operating_system: string>, geo struct<country: string, region: string>"""


def event(user, moment, name="first_open", system="ANDROID", country="Canada", region="Ontario"):
    micros = int((moment - T(1970, 1, 1)).total_seconds() * 1_000_000)
    return (user, moment.date(), micros, name, ("mobile", system), (country, region))


def test_first_opens(spark):
    daily = spark.createDataFrame(
        [
            event("a", T(2019, 3, 1, 4)),
            event("b", T(2019, 3, 1, 4, 30)),
            event("c", T(2019, 3, 1, 4), system=None),
            event("d", T(2019, 3, 1, 4), country="France"),
            event("e", T(2019, 3, 1, 4), name="view"),
            event("f", T(2019, 3, 1, 18), region=None),
        ],
        EVENT,
    )
    intraday = spark.createDataFrame([event("g", T(2019, 3, 1, 3))], EVENT)
    cube = cubes.first_opens_cube(daily, intraday)
    assert column(cube, "date") == sorted(column(cube, "date"))
    got = Counter(tuples(cube, "date", "operating_system", "time", "region", "first_open"))
    assert got == Counter(
        [
            (F28, "Android", "Evening", "Ontario", 2),
            (F28, "iOS", "Evening", "Ontario", 1),
            # The same group in the intraday shard is a row of its own.
            (F28, "Android", "Evening", "Ontario", 1),
            (M1, "Android", "Evening", None, 1),
        ]
    )
    assert sorted(tuples(reports.app_by_os(cube))) == [("Android", 4), ("iOS", 1)]
    corrected = cubes.first_opens_cube(daily, intraday, corrected=True)
    assert set(column(corrected.where("region is null"), "time")) == {"Afternoon"}


def test_distinct_first_opens(spark):
    twice = [event("a", T(2019, 3, 1, 19)), event("a", T(2019, 3, 1, 19)), event("b", T(2019, 3, 1, 19), name="x")]
    keys = cubes.first_open_keys(spark.createDataFrame(twice, EVENT))
    assert tuples(keys, "user_pseudo_id", "hour", "country") == [("a", "Evening", "Canada")]
