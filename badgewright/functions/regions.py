"""Region names, operating systems and local time of mobile events.

Local time is computed on microseconds since the epoch, so that no result
depends on the session's time zone. The zones are literals in a CASE: Spark
resolves a literal zone once, a zone taken from a column again for every row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from badgewright.fixed import OTHER_ZONE, REGION_NAMES, REGION_ZONES
from badgewright.functions.labels import col_of

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def epoch_micros(ts_ntz: Column | str) -> Column:
    """Microseconds of a zone-less UTC timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col_of(ts_ntz))


def local_micros(micros: Column | str, region: Column | str) -> Column:
    """Wall-clock microseconds in the zone of the region."""
    instant, r = F.timestamp_micros(col_of(micros)), col_of(region)

    def in_zone(zone: str) -> Column:
        return F.unix_micros(F.from_utc_timestamp(instant, zone))

    local = F
    for regions, zone in REGION_ZONES:
        local = local.when(r.isin(regions), in_zone(zone))
    return local.otherwise(in_zone(OTHER_ZONE))


def date_of_micros(micros: Column | str) -> Column:
    m = col_of(micros)
    days = (m - F.pmod(m, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)
    return F.date_from_unix_date(days.cast("int"))


def hour_of_micros(micros: Column | str) -> Column:
    m = F.pmod(col_of(micros), F.lit(MICROS_PER_DAY))
    return F.floor(m / F.lit(MICROS_PER_HOUR)).cast("int")


def region_name(region: Column | str) -> Column:
    r = col_of(region)
    name = F
    for raw, shown in REGION_NAMES:
        name = name.when(r == raw, F.lit(shown))
    return name.otherwise(r)


def os_name(operating_system: Column | str) -> Column:
    """Android or, for everything else and for unknown, iOS."""
    return F.when(col_of(operating_system) == "ANDROID", "Android").otherwise("iOS")
