"""The catalog's queries in plain SQL, written from the definitions, not from the plans."""

from __future__ import annotations

from badgewright.catalog import queries as q
from badgewright.catalog.adapters import INTRADAY_FROM, REGIONS
from badgewright.fixed import PERIODS, POSTAL_DISTRICTS, PROVINCES


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


def _values(rows) -> str:
    return ", ".join(f"({_list(row)})" for row in rows)


AGE = """CASE WHEN {a} < 5 THEN '0-4' WHEN {a} < 18 THEN '5-17' WHEN {a} < 25 THEN '18-24'
  WHEN {a} < 35 THEN '25-34' WHEN {a} < 45 THEN '35-44' WHEN {a} < 55 THEN '45-54'
  WHEN {a} < 65 THEN '55-64' ELSE '65+' END"""
BADGE_PART = """CASE WHEN {h} > 17 THEN 'Evening' WHEN {h} > 11 THEN 'Afternoon'
  WHEN {h} > 5 THEN 'Morning' ELSE 'Night' END"""
REWARD_PART = """CASE WHEN {h} BETWEEN 6 AND 11 THEN 'Morning' WHEN {h} BETWEEN 12 AND 16 THEN 'Afternoon'
  WHEN {h} BETWEEN 17 AND 21 THEN 'Evening' WHEN {h} >= 22 OR {h} <= 5 THEN 'Night' END"""
APP_PART = "CASE {o} + ({h} // 6) WHEN 0 THEN 'Night' WHEN 1 THEN 'Morning' WHEN 2 THEN 'Afternoon' ELSE 'Evening' END"
CAPITAL = "upper(substring({g}, 1, 1)) || lower(substring({g}, 2))"
QUARTER = "'Q' || quarter({d}) || ' ' || year({d})"
MONTH = "strftime({d}, '%b %Y')"
MINUTES = """CASE WHEN {t} IS NULL THEN NULL WHEN position(' ' IN {t}) = 0 THEN 0
  ELSE coalesce(try_cast(substring({t}, 1, position(' ' IN {t}) - 1) AS BIGINT), 0) END"""

RELATIONS = {
    "cust": """SELECT c_custkey AS uid, c_nationkey % 5 AS user_selected_level, c_mktsegment AS gender,
      CAST(nullif((c_custkey * 7) % 90, 0) AS INTEGER) AS age,
      chr(65 + c_nationkey) || '1A' AS postal_code, c_nationkey FROM customer""",
    "prov": f"SELECT * FROM (VALUES {_values(PROVINCES)}) v(province_postcode, province_code, province)",
    "district": f"SELECT * FROM (VALUES {_values(POSTAL_DISTRICTS)}) v(initial, province)",
    "badge_events": """SELECT event_id, user_id AS customer_id, event_type AS label, ts AS created_at,
      CAST(ts AS DATE) AS date, 1 AS cnt, user_selected_level, gender, age, postal_code, c_nationkey
      FROM events JOIN cust ON uid = user_id""",
    "win": f"SELECT * FROM badge_events WHERE date BETWEEN DATE '{q.FIRST}' AND DATE '{q.LAST}'",
    "chosen": f"SELECT * FROM win WHERE label IN ({_list(q.LABELS)})",
    "tot": """SELECT CAST(sum(cnt) AS BIGINT) AS total_awards, count(DISTINCT customer_id) AS unique_users
      FROM badge_events""",
    "grouped": f"""SELECT customer_id, label, date, {BADGE_PART.format(h='hour(created_at)')} AS hour,
      user_selected_level, count(*) AS cnt FROM win GROUP BY ALL""",
    "histo": """WITH per AS (SELECT customer_id, count(*) AS badges FROM grouped GROUP BY 1),
      seen AS (SELECT badges, count(*) AS users FROM per GROUP BY 1),
      spine AS (SELECT unnest(generate_series(0, max(badges))) AS badges FROM seen)
      SELECT spine.badges, coalesce(users, 0) AS users,
        CAST(sum(coalesce(users, 0)) OVER (ORDER BY spine.badges) AS BIGINT) AS cum,
        CAST(sum(users) OVER () AS BIGINT) AS n
      FROM spine LEFT JOIN seen ON seen.badges = spine.badges""",
    "histogram": """SELECT badges, users, CAST(100 AS DOUBLE) * users / n AS distribution,
      CAST(100 AS DOUBLE) * users / n AS penetration, CAST(100 AS DOUBLE) * cum / n AS cum_distribution,
      CAST(100 AS DOUBLE) * cum / n AS cum_penetration FROM histo""",
    "cust_award": """SELECT o_custkey AS customer_id, l_partkey AS award_id, l_shipdate AS created_at
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "award": """SELECT p_partkey AS uid, 'A' || p_size ||
      CASE WHEN p_size % 10 = 0 AND p_partkey % 2 = 0 THEN 'x' ELSE '' END AS award_code,
      p_size % 10 AS num_ballots FROM part""",
    "src": """SELECT p_partkey AS master_id, p_size,
      CASE WHEN p_type = 'PROMO' THEN p_size || ' Minutes Milestone' ELSE p_name END AS d FROM part""",
    "trans": """SELECT master_id, 'en' AS language_code, d AS label FROM src WHERE p_size % 7 <> 0
      UNION ALL SELECT master_id, 'fr', 'fr ' || d FROM src WHERE p_size % 2 = 0
      UNION ALL SELECT master_id, 'es', 'es ' || d FROM src WHERE p_size % 5 = 0""",
    "miles": f"""SELECT master_id, {MINUTES.format(t='label')} AS minutes FROM trans
      WHERE language_code = 'en' AND contains(lower(label), 'milestone')""",
    "codes": "SELECT DISTINCT award_code, minutes FROM award JOIN miles ON master_id = uid",
    "top": """SELECT customer_id, award_code AS max_award_code FROM
      (SELECT customer_id, max(minutes) AS minutes FROM cust_award JOIN miles ON master_id = award_id GROUP BY 1) best
      JOIN codes ON codes.minutes = best.minutes""",
    "cube": f"""SELECT ca.customer_id, ca.customer_id AS appuser_id, award_code, max_award_code, label,
        {CAPITAL.format(g='gender')} AS gender, {AGE.format(a='age')} AS age, user_selected_level,
        {QUARTER.format(d='created_at')} AS quarter, {MONTH.format(d='created_at')} AS month,
        CAST(created_at AS DATE) AS date, {BADGE_PART.format(h='hour(created_at)')} AS hour,
        count(label) AS count, upper(substring(postal_code, 1, 1)) AS province_postcode
      FROM cust_award ca JOIN award ON award.uid = award_id
      JOIN trans ON master_id = award_id AND language_code = 'en'
      JOIN cust ON cust.uid = ca.customer_id JOIN top ON top.customer_id = ca.customer_id
      GROUP BY ALL""",
    "qa": """SELECT c_custkey AS userid, CASE WHEN c_custkey % 2 = 0 THEN 'onboarding' ELSE 'weekly' END AS type,
      CASE WHEN c_custkey % 3 = 0 THEN 'activityLevel' ELSE 'goal' END AS questionkey,
      c_mktsegment AS answer FROM customer""",
    "fact": f"""SELECT ra.customer_id, b.l_shipdate AS created_at, user_selected_level,
        {CAPITAL.format(g='gender')} AS gender,
        CASE WHEN cust.uid IS NOT NULL THEN {AGE.format(a='age')} END AS age, age AS age_years, postal_code,
        trans.label, num_ballots, cycle_type, district.province, CAST(b.l_shipdate AS DATE) AS date,
        {REWARD_PART.format(h='hour(b.l_shipdate)')} AS hour
      FROM lineitem b
      LEFT JOIN (SELECT s_suppkey, cycle_type FROM supplier LEFT JOIN
          (SELECT n_nationkey, r_name AS cycle_type FROM nation JOIN region ON r_regionkey = n_regionkey) cy
          ON n_nationkey = nullif(s_nationkey, 24)) ci ON s_suppkey = nullif(b.l_suppkey, 0)
      LEFT JOIN (SELECT o_orderkey AS uid, o_custkey AS customer_id,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE o_orderkey % (SELECT max(p_partkey) + 1 FROM part) END AS award_id FROM orders) ra
        ON ra.uid = b.l_orderkey
      LEFT JOIN award ON award.uid = ra.award_id
      LEFT JOIN cust ON cust.uid = ra.customer_id
      LEFT JOIN district ON district.initial = upper(substring(postal_code, 1, 1))
      LEFT JOIN trans ON trans.master_id = ra.award_id AND trans.language_code <> 'fr'""",
    "oe": """SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS label, 1 AS cnt
      FROM orders""",
    "opens": f"""SELECT event_id, user_id, epoch_us(ts) AS micros, CAST(ts AS DATE) AS event_date, ts,
      CASE WHEN event_type = 'signup' THEN 'first_open' ELSE event_type END AS event_name, gender AS category,
      CASE event_id % 3 WHEN 0 THEN 'ANDROID' WHEN 1 THEN 'IOS' END AS operating_system,
      CASE WHEN c_nationkey % 5 = 4 THEN 'United States' ELSE 'Canada' END AS country,
      [{_list(REGIONS)}][c_nationkey % 14 + 1] AS region FROM events JOIN cust ON uid = user_id""",
    "local": """SELECT *, (make_timestamp(micros) AT TIME ZONE 'UTC') AT TIME ZONE CASE
        WHEN region IN ('Ontario', 'Quebec', 'Nunavut') THEN 'America/Toronto'
        WHEN region IN ('Manitoba', 'Saskatchewan') THEN 'America/Winnipeg'
        WHEN region IN ('Northwest Territories', 'Alberta') THEN 'America/Yellowknife'
        WHEN region IN ('British Columbia', 'Yukon Territory') THEN 'America/Los_Angeles'
        ELSE 'America/Moncton' END AS lt,
      CASE WHEN operating_system = 'ANDROID' THEN 'Android' ELSE 'iOS' END AS os,
      CASE WHEN region = 'Newfoundland and Labrador' THEN 'Newfoundland & Labrador'
        WHEN region = 'Quebec' THEN 'Québec'
        WHEN region IN ('Northwest Territories', 'Nunavut') THEN 'NW Territories & Nunavut'
        ELSE region END AS region_shown FROM opens""",
}

# What each relation reads, so that a query only carries those it needs.
NEEDS = {
    "badge_events": ["cust"],
    "win": ["badge_events"],
    "chosen": ["win"],
    "tot": ["badge_events"],
    "grouped": ["win"],
    "histo": ["grouped"],
    "histogram": ["histo"],
    "trans": ["src"],
    "miles": ["trans"],
    "codes": ["award", "miles"],
    "top": ["cust_award", "codes"],
    "cube": ["top", "cust"],
    "fact": ["award", "cust", "district", "trans"],
    "opens": ["cust"],
    "local": ["opens"],
}


def _with(*names: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in ordered) + "\n"


def _shares(total: str, users: str) -> str:
    return f"""CAST(100 AS DOUBLE) * {total} / tot.total_awards AS distribution,
      CAST(100 AS DOUBLE) * {users} / tot.unique_users AS penetration,
      round(CAST({total} AS DOUBLE) / {users}, 2) AS per_user"""


def _percent(x: str) -> str:
    return f"format('{{:.2f}}%', round({x}, 2))"


def _summary_of(rows: str, labels: list[str], totals: str) -> str:
    return f"""SELECT CAST(list_position([{_list(labels)}], s.label) AS BIGINT) AS ord,
      s.label, s.total, s.unique_users, {_shares('s.total', 's.unique_users')}
      FROM (SELECT label, CAST(sum(cnt) AS BIGINT) AS total, count(DISTINCT customer_id) AS unique_users
            FROM {rows} GROUP BY label) s, {totals} tot"""


def _period_sql() -> str:
    parts = []
    for code in PERIODS.values():
        for mode in ("Previous", "Year ago"):
            unit = {"m": ("month", 1), "q": ("quarter", 3), "y": ("year", 12)}.get(code[0])
            year_ago = "CAST({s} - INTERVAL 12 MONTH AS DATE)"
            if unit:
                name, months = unit
                start = f"CAST(date_trunc('{name}', d) AS DATE)"
                if code.endswith("p"):
                    start = f"CAST({start} - INTERVAL {months} MONTH AS DATE)"
                end = f"CAST({start} + INTERVAL {months} MONTH AS DATE) - 1"
                back = f"CAST({start} - INTERVAL {months} MONTH AS DATE)"
                cmp_start = back if mode == "Previous" else year_ago.format(s=start)
                cmp_end = f"CAST({cmp_start} + INTERVAL {months} MONTH AS DATE) - 1"
            else:
                days = 7 if code[0] == "w" else int(code)
                if code[0] == "w":
                    start = f"(d + 1 - CAST(dayofweek(d) AS INTEGER) - {7 if code == 'wp' else 0})"
                    end = f"{start} + 6"
                else:
                    start, end = f"(d - {days})", "d - 1"
                cmp_start = f"({start} - {days})" if mode == "Previous" else year_ago.format(s=start)
                cmp_end = f"{cmp_start} + {days - 1}"
            parts.append(
                f"SELECT d AS as_of, '{code}' AS code, '{mode}' AS compare, {start} AS start, {end} AS \"end\", "
                f"{cmp_start} AS cmp_start, {cmp_end} AS cmp_end FROM days"
            )
    return "\nUNION ALL ".join(parts)


def _window(first: str, last: str, shift: int = 0) -> str:
    return f"date BETWEEN DATE '{first}' - {shift} AND DATE '{last}' - {shift}"


def _total(first: str, last: str, shift: int = 0) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {_window(first, last, shift)} THEN cnt END), 0) AS BIGINT)"


def _growth(now: str, before: str) -> str:
    return f"CASE WHEN {before} >= 1 THEN CAST({now} - {before} AS DOUBLE) / {before} END"


def _tiles(rows: str) -> str:
    f, l = q.ORDERS_FIRST, q.ORDERS_LAST
    return f"""SELECT s.badges, s.customers, round(CAST(s.badges AS DOUBLE) / s.customers, 2) AS badges_per_customer,
      (SELECT count(*) FROM (SELECT customer_id FROM {rows} WHERE {_window(f, l)}
        EXCEPT SELECT customer_id FROM {rows} WHERE {_window(f, l, 30)})) AS new_users,
      {_growth('s.badges', 's.d7')} AS growth_7, {_growth('s.badges', 's.d30')} AS growth_30
      FROM (SELECT {_total(f, l)} AS badges, {_total(f, l, 7)} AS d7, {_total(f, l, 30)} AS d30,
        count(DISTINCT CASE WHEN {_window(f, l)} THEN customer_id END) AS customers FROM {rows}) s"""


PIVOT = ", ".join(
    f"CAST(sum(CASE WHEN coalesce(cycle_type, '<NA>') = '{c}' THEN 1 END) AS BIGINT) AS \"{c}\"" for c in q.CYCLES
) + f", CAST(sum(CASE WHEN coalesce(cycle_type, '<NA>') NOT IN ({_list(q.CYCLES)}) THEN 1 END) AS BIGINT) AS \"<other>\""
REWARD_WINDOW = f"""date BETWEEN DATE '{q.REWARDS_FIRST}' AND DATE '{q.REWARDS_LAST}'
  AND label IN ({_list(q.REWARD_LABELS)})"""
FIRST_OPENS = " UNION ALL ".join(
    f"""SELECT CAST(lt AS DATE) AS date, count(*) AS first_open, category, os AS operating_system,
      {APP_PART.format(o=1, h='hour(lt)')} AS time, region_shown AS region FROM local
      WHERE event_name = 'first_open' AND country = 'Canada' AND event_date {side} DATE '{INTRADAY_FROM}'
      GROUP BY ALL"""
    for side in ("<", ">=")
)
LABEL_TEXT = """CASE p_type WHEN 'PROMO' THEN p_size || ' Minutes Milestone'
  WHEN 'SMALL' THEN 'Weekly Challenge Completed' WHEN 'LARGE' THEN 'Weekly Challenge Complete'
  WHEN 'ECONOMY' THEN CAST(p_size AS VARCHAR) ELSE upper(p_name) END"""
EVENT_ROW = "event_id, customer_id, label, date"

ORACLE: dict[str, str] = {
    "badge_summary": _with("chosen", "tot") + _summary_of("chosen", q.LABELS, "tot"),
    "badge_summary_filtered": _with("chosen", "tot")
    + _summary_of(
        f"(SELECT * FROM chosen WHERE gender = 'BUILDING' AND {BADGE_PART.format(h='hour(created_at)')} = 'Evening')",
        q.LABELS,
        "tot",
    ),
    "badge_summary_display": _with("chosen", "tot")
    + f"""SELECT ord AS ord_rank, ord, label AS label_rank, label, total AS total_rank, total,
      unique_users AS unique_users_rank, unique_users, {_percent('distribution')} AS distribution_rank, distribution,
      {_percent('penetration')} AS penetration_rank, penetration, per_user AS per_user_rank, per_user
      FROM ({_summary_of('chosen', q.LABELS, 'tot')})""",
    "badge_subtotal": _with("chosen", "tot")
    + f"""SELECT 'Total' AS label, s.total, s.unique_users, {_shares('s.total', 's.unique_users')}
      FROM (SELECT CAST(sum(cnt) AS BIGINT) AS total, count(DISTINCT customer_id) AS unique_users
            FROM chosen) s, tot""",
    "badge_rollup": _with("chosen")
    + """SELECT label, CAST(sum(cnt) AS BIGINT) AS total, count(DISTINCT customer_id) AS unique_users
      FROM chosen GROUP BY label UNION ALL
      SELECT 'Total', CAST(sum(cnt) AS BIGINT), count(DISTINCT customer_id) FROM chosen""",
    "badge_delta": _with("badge_events")
    + f"""SELECT *, total - total_prev AS delta,
      CASE WHEN total_prev <> 0 THEN CAST(100 AS DOUBLE) * (total - total_prev) / total_prev END AS pct
      FROM (SELECT label, {_total(q.FIRST, q.LAST)} AS total, {_total(q.FIRST, q.LAST, 7)} AS total_prev
        FROM badge_events WHERE label IN ({_list(q.LABELS)})
        AND ({_window(q.FIRST, q.LAST)} OR {_window(q.FIRST, q.LAST, 7)}) GROUP BY label)""",
    "badge_histogram": _with("histogram") + "SELECT * FROM histogram",
    "badge_histogram_display": _with("histogram")
    + "SELECT badges AS badges_rank, badges, users AS users_rank, users, "
    + ", ".join(
        f"{_percent(c)} AS {c}_rank, {c}"
        for c in ("distribution", "penetration", "cum_distribution", "cum_penetration")
    )
    + " FROM histogram",
    "activity_levels": _with("grouped")
    + """SELECT level, n, CAST(100 AS DOUBLE) * n / sum(n) OVER () AS share,
      CAST(100 AS DOUBLE) * sum(n) OVER (ORDER BY level) / sum(n) OVER () AS cum_share
      FROM (SELECT user_selected_level AS level, count(*) AS n FROM grouped GROUP BY 1)""",
    "activity_goals": _with("cube")
    + f""", cubes AS (SELECT customer_id, label, date, count AS cnt FROM cube)
      {_summary_of(
          f"(SELECT * FROM cubes WHERE label IN ({_list(q.GOALS)}) AND {_window(q.GOALS_FIRST, q.GOALS_LAST)})",
          q.GOALS,
          "(SELECT CAST(sum(cnt) AS BIGINT) AS total_awards, count(DISTINCT customer_id) AS unique_users FROM cubes)",
      )}""",
    "daily_series": _with("win") + "SELECT date, CAST(sum(cnt) AS BIGINT) AS n FROM win GROUP BY date",
    "page_rows": _with("badge_events")
    + "SELECT date, CAST(sum(cnt) AS BIGINT) AS n FROM badge_events GROUP BY date ORDER BY date LIMIT 10 OFFSET 10",
    "grand_totals": _with("tot") + "SELECT * FROM tot",
    "date_range_filter": _with("win") + f"SELECT {EVENT_ROW} FROM win",
    "dim_filter": _with("badge_events")
    + f"SELECT {EVENT_ROW} FROM badge_events WHERE gender = 'BUILDING' AND user_selected_level = 3",
    "label_in": _with("badge_events")
    + f"SELECT {EVENT_ROW} FROM badge_events WHERE label IN ('purchase', 'error')",
    "filter_choices": _with("badge_events", "prov", "top")
    + f""", dims AS (SELECT {AGE.format(a='age')} AS age, {MONTH.format(d='date')} AS month,
        {QUARTER.format(d='date')} AS quarter, gender, province, CAST(user_selected_level AS VARCHAR) AS lvl
        FROM badge_events LEFT JOIN prov ON province_postcode = upper(substring(postal_code, 1, 1)))
      SELECT DISTINCT * FROM (
        SELECT 'age' AS dimension, age AS value FROM dims UNION ALL SELECT 'month', month FROM dims
        UNION ALL SELECT 'quarter', quarter FROM dims UNION ALL SELECT 'gender', gender FROM dims
        UNION ALL SELECT 'province', province FROM dims UNION ALL SELECT 'user_selected_level', lvl FROM dims
        UNION ALL SELECT 'max_award_code', max_award_code FROM top
        UNION ALL SELECT 'hour', unnest(['Morning', 'Afternoon', 'Evening', 'Night'])) WHERE value IS NOT NULL""",
    "dim_labels": _with("badge_events")
    + f"""SELECT event_id, {CAPITAL.format(g='gender')} AS gender, {AGE.format(a='age')} AS age,
      upper(substring(postal_code, 1, 1)) AS province_postcode, {QUARTER.format(d='date')} AS quarter,
      {MONTH.format(d='date')} AS month, dayname(date) AS weekday, date,
      CAST(hour(created_at) AS INTEGER) AS hour FROM badge_events""",
    "day_parts": f"""SELECT event_id, {BADGE_PART.format(h='hour(ts)')} AS badge_part,
      {REWARD_PART.format(h='hour(ts)')} AS rewards_part, {APP_PART.format(o=1, h='hour(ts)')} AS app_part,
      {APP_PART.format(o=0, h='hour(ts)')} AS app_part_corrected FROM events""",
    "label_minutes": f"""SELECT p_partkey,
      array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
      {MINUTES.format(t='t')} AS minutes, replace(t, 'Weekly Challenge Complete', 'Weekly') AS cleaned
      FROM (SELECT p_partkey, {LABEL_TEXT} AS t FROM part)""",
    "safe_math": f"""SELECT key, coalesce(d, 0) AS pct_diff, coalesce({_percent('d')}, '--') AS pct_text,
      CASE WHEN key % 10 = 0 THEN 0.0::DOUBLE ELSE round(o_totalprice, 0) END AS rounded,
      format('{{:,}}', x) AS grouped
      FROM (SELECT *, CASE WHEN y <> 0 THEN CAST(100 AS DOUBLE) * (x - y) / y END AS d
        FROM (SELECT o_orderkey AS key, o_totalprice, CAST(floor(o_totalprice) AS BIGINT) AS x,
          o_custkey % 50 AS y FROM orders))""",
    "period_table": "WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)\n" + _period_sql(),
    "period_rollup": _with("oe")
    + f""", days AS (SELECT DATE '{q.ORDERS_AS_OF}' AS d), p AS ({_period_sql()})
      SELECT code, compare,
        CAST((SELECT count(*) FROM oe WHERE date BETWEEN p.start AND p."end") AS BIGINT) AS current,
        CAST((SELECT count(*) FROM oe WHERE date BETWEEN p.cmp_start AND p.cmp_end) AS BIGINT) AS comparison
      FROM p""",
    "kpi_tiles": _with("oe") + _tiles("oe"),
    "kpi_tiles_display": _with("oe")
    + f""", urgent AS (SELECT * FROM oe WHERE label = '1-URGENT'), tiles AS ({_tiles('urgent')})
      SELECT format('{{:,}}', badges) AS badges, format('{{:,}}', customers) AS customers,
        format('{{:.2f}}', badges_per_customer) AS badges_per_customer, format('{{:,}}', new_users) AS new_users,
        coalesce({_percent('100 * growth_7')}, 'N/A') AS growth_7,
        coalesce({_percent('100 * growth_30')}, 'N/A') AS growth_30 FROM tiles""",
    "kpi_growth": _with("oe")
    + "SELECT badges, "
    + ", ".join(f"badges_{d}, {_growth('badges', f'badges_{d}')} AS growth_{d}" for d in (7, 30, 90))
    + f" FROM (SELECT {_total(q.ORDERS_FIRST, q.ORDERS_LAST)} AS badges, "
    + ", ".join(f"{_total(q.ORDERS_FIRST, q.ORDERS_LAST, d)} AS badges_{d}" for d in (7, 30, 90))
    + " FROM oe)",
    "new_users": _with("badge_events")
    + f"""SELECT customer_id FROM badge_events WHERE label = 'purchase' AND {_window(q.FIRST, q.LAST)}
      EXCEPT SELECT customer_id FROM badge_events WHERE label = 'purchase' AND {_window(q.FIRST, q.LAST, 7)}""",
    "badge_cube": _with("cube") + "SELECT * FROM cube",
    "badge_cube_province": _with("cube", "prov")
    + """SELECT cube.province_postcode, province_code, province,
      replace(label, 'Weekly Challenge Complete', 'Weekly') AS label, quarter, count(*) AS n_rows,
      CAST(sum(count) AS BIGINT) AS count
      FROM cube LEFT JOIN prov ON prov.province_postcode = cube.province_postcode GROUP BY ALL""",
    "badge_cube_answers": _with("cust_award", "award", "trans", "cust", "qa")
    + f"""SELECT ca.customer_id, ca.customer_id AS appuser_id, label,
        {CAPITAL.format(g='gender')} AS gender, {AGE.format(a='age')} AS age, answer,
        {QUARTER.format(d='created_at')} AS quarter, {MONTH.format(d='created_at')} AS month,
        CAST(created_at AS DATE) AS date, {BADGE_PART.format(h='hour(created_at)')} AS hour,
        count(label) AS count, upper(substring(postal_code, 1, 1)) AS province_postcode
      FROM cust_award ca JOIN award ON award.uid = award_id
      JOIN trans ON master_id = award_id AND language_code = 'en'
      JOIN cust ON cust.uid = ca.customer_id
      LEFT JOIN qa ON userid = cust.uid AND type = 'onboarding' AND questionkey = 'activityLevel'
      GROUP BY ALL""",
    "milestone_codes": _with("codes") + "SELECT * FROM codes",
    "milestone_top": _with("top") + "SELECT * FROM top",
    "onboarding_answer": _with("cust", "qa")
    + """SELECT uid AS customer_id, answer FROM cust
      LEFT JOIN (SELECT * FROM qa WHERE type = 'onboarding' AND questionkey = 'activityLevel') ON userid = uid""",
    "rewards_fact": _with("fact")
    + f"""SELECT * REPLACE (CAST(created_at AS VARCHAR) AS created_at), {QUARTER.format(d='date')} AS quarter,
      {MONTH.format(d='date')} AS month, dayname(date) AS day, CAST(1 AS BIGINT) AS count FROM fact""",
    "left_on_theta": _with("award", "trans")
    + """SELECT uid AS award_id, language_code, label AS description FROM award
      LEFT JOIN trans ON master_id = uid AND language_code <> 'fr'""",
    "rewards_province": _with("cust", "district")
    + """SELECT uid AS customer_id, province FROM cust
      LEFT JOIN district ON initial = upper(substring(postal_code, 1, 1))""",
    "rewards_counts": _with("fact") + "SELECT label, cycle_type, count(*) AS n FROM fact GROUP BY ALL",
    "rewards_pivot": _with("fact") + f"SELECT label, {PIVOT} FROM fact WHERE {REWARD_WINDOW} GROUP BY label",
    "rewards_pivot_filtered": _with("fact")
    + f"""SELECT label, {PIVOT} FROM fact WHERE {REWARD_WINDOW} AND gender = 'Building' AND hour = 'Night'
      GROUP BY label""",
    "event_date_range": f"""SELECT CAST(ts AS DATE) AS event_date, count(*) AS n FROM events
      WHERE CAST(ts AS DATE) BETWEEN DATE '{q.FIRST}' AND DATE '{q.LAST}' GROUP BY 1""",
    "first_opens_distinct": _with("opens")
    + f"""SELECT DISTINCT user_id AS user_pseudo_id, event_date, micros AS event_timestamp,
      {BADGE_PART.format(h='hour(ts)')} AS hour, event_name, category, operating_system, country, region
      FROM opens WHERE event_name = 'first_open'""",
    "first_opens_struct": _with("opens")
    + "SELECT event_id, category, operating_system, country, region FROM opens",
    "region_timezone": _with("local")
    + """SELECT event_id, CAST(lt AS DATE) AS local_date, CAST(hour(lt) AS INTEGER) AS local_hour,
      region_shown AS region, os FROM local""",
    "first_opens_cube": _with("local") + FIRST_OPENS,
    "app_by_os": _with("local")
    + f"""SELECT operating_system, CAST(sum(first_open) AS BIGINT) AS first_open FROM ({FIRST_OPENS})
      GROUP BY operating_system""",
    "csv_roundtrip": "SELECT * FROM customer",
    "first_opens_refreshed": _with("local")
    + f"""SELECT CAST(lt AS DATE) AS date, count(*) AS first_open, category, os AS operating_system,
      {APP_PART.format(o=1, h='hour(lt)')} AS time, region_shown AS region FROM local
      WHERE event_name = 'first_open' AND country = 'Canada' GROUP BY ALL""",
    "sketch_summary": _with("chosen")
    + """SELECT label, CAST(sum(cnt) AS BIGINT) AS total, count(DISTINCT customer_id) AS unique_users
      FROM chosen GROUP BY label""",
    "sketch_tiles": _with("oe") + _tiles("oe"),
    "period_customers": _with("oe")
    + f""", days AS (SELECT DATE '{q.ORDERS_AS_OF}' AS d), p AS ({_period_sql()})
      SELECT code, compare,
        (SELECT count(DISTINCT customer_id) FROM oe WHERE date BETWEEN p.start AND p."end") AS current,
        (SELECT count(DISTINCT customer_id) FROM oe WHERE date BETWEEN p.cmp_start AND p.cmp_end) AS comparison
      FROM p""",
    "running_orders": """SELECT *, CAST(sum(amount) OVER (ORDER BY date, o_orderkey) AS BIGINT) AS running
      FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders)""",
    "running_customer_shares": _with("oe")
    + """SELECT customer_id, n, CAST(100 AS DOUBLE) * n / sum(n) OVER () AS share,
      CAST(100 AS DOUBLE) * sum(n) OVER (ORDER BY n DESC, customer_id) / sum(n) OVER () AS cum_share
      FROM (SELECT customer_id, count(*) AS n FROM oe GROUP BY 1)""",
    "order_positions": """SELECT o_orderkey, o_orderstatus, o_totalprice,
      row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders""",
    "period_sums_prefix": _with("oe")
    + f""", days AS (SELECT DATE '{q.ORDERS_AS_OF}' AS d), p AS ({_period_sql()})
      SELECT code, compare, label,
        (SELECT count(*) FROM oe WHERE oe.label = l.label AND date BETWEEN p.start AND p."end") AS current,
        (SELECT count(*) FROM oe WHERE oe.label = l.label AND date BETWEEN p.cmp_start AND p.cmp_end) AS comparison
      FROM p, (SELECT DISTINCT label FROM oe) l""",
    "kpi_growth_prefix": _with("oe")
    + "SELECT label, badges, "
    + ", ".join(f"badges_{d}, {_growth('badges', f'badges_{d}')} AS growth_{d}" for d in (7, 30, 90))
    + f" FROM (SELECT label, {_total(q.ORDERS_FIRST, q.ORDERS_LAST)} AS badges, "
    + ", ".join(f"{_total(q.ORDERS_FIRST, q.ORDERS_LAST, d)} AS badges_{d}" for d in (7, 30, 90))
    + " FROM oe GROUP BY label)",
    "bitmap_pairs": _with("badge_events")
    + f"""SELECT gender, {AGE.format(a='age')} AS age, count(DISTINCT customer_id) AS unique_users
      FROM badge_events GROUP BY ALL""",
    "bitmap_filter": _with("badge_events")
    + """SELECT count(DISTINCT customer_id) AS unique_users FROM badge_events
      WHERE gender IN ('BUILDING', 'MACHINERY') AND label = 'purchase' AND user_selected_level IN (1, 2, 3)""",
    "label_lists": _with("win")
    + f""", names AS (SELECT [{_list([*q.LABELS, 'signup'])}] AS l), masks AS (SELECT unnest(range(1, 32)) AS mask),
      lists AS (SELECT mask, list_filter(l, lambda x: (mask >> (list_position(l, x) - 1)) & 1 = 1) AS own FROM masks, names)
      SELECT mask, array_to_string(own, ', ') AS labels,
        (SELECT CAST(sum(cnt) AS BIGINT) FROM win WHERE list_contains(own, label)) AS total,
        (SELECT count(DISTINCT customer_id) FROM win WHERE list_contains(own, label)) AS unique_users
      FROM lists""",
    "label_list_summaries": _with("oe")
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS name, CAST(sum(cnt) AS BIGINT) AS total, count(DISTINCT customer_id) AS unique_users
      FROM oe WHERE label IN ({_list(own)}) AND {_window(q.ORDERS_FIRST, q.ORDERS_LAST)}"""
        for name, own in q.PRIORITY_LISTS.items()
    ),
    "csv_line_breaks": """SELECT c_custkey, c_name || chr(10) || 'says "' || c_mktsegment || '",' || chr(10) || chr(10) || c_mktsegment
      AS note, c_acctbal FROM customer""",
    "csv_inferred": """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey,
      CAST(CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS INTEGER) AS o_custkey, o_totalprice,
      CAST(o_orderdate AS DATE) AS day, o_orderpriority = '1-URGENT' AS urgent, o_orderpriority FROM orders""",
    "page_deep": f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
      LIMIT {q.DEEP_PAGE[1]} OFFSET {(q.DEEP_PAGE[0] - 1) * q.DEEP_PAGE[1]}""",
}
