"""Text and calendar labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from badgewright.fixed import AGE_BANDS, OLDEST_BAND, WEEKLY_BADGE


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capitalised(text: Column | str) -> Column:
    """First character upper, rest lower (``initcap`` would touch every word)."""
    t = col_of(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 2**31 - 1)))


def title_case(text: Column | str) -> Column:
    return F.initcap(col_of(text))


def postal_initial(postal_code: Column | str) -> Column:
    return F.upper(F.substring(col_of(postal_code), 1, 1))


def age_band(age: Column | str) -> Column:
    """Band of an age in years; an unknown age falls in the oldest band."""
    a = col_of(age)
    band = F
    for upper, label in AGE_BANDS:
        band = band.when(a < upper, F.lit(label))
    return band.otherwise(F.lit(OLDEST_BAND))


def date_of(ts: Column | str) -> Column:
    return F.to_date(col_of(ts))


def date_of_text(text: Column | str, fmt: str = "MM/dd/yyyy") -> Column:
    """Date written as text; NULL where it does not parse."""
    return F.try_to_date(col_of(text), fmt)


def quarter_label(date: Column | str) -> Column:
    d = col_of(date)
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))


def month_label(date: Column | str) -> Column:
    return F.date_format(col_of(date), "MMM yyyy")


def weekday_name(date: Column | str) -> Column:
    return F.date_format(col_of(date), "EEEE")


def weekly_label(text: Column | str) -> Column:
    """Shorten the weekly badge's name wherever it occurs in the text."""
    return F.replace(col_of(text), F.lit(WEEKLY_BADGE[0]), F.lit(WEEKLY_BADGE[1]))


def is_milestone(text: Column | str) -> Column:
    return F.lower(col_of(text)).contains("milestone")


def leading_minutes(text: Column | str) -> Column:
    """Number that starts the first word of a text, 0 if there is none or only one word."""
    t = col_of(text)
    digits = F.regexp_extract(t, r"^(\d+)\S* ", 1)
    return F.when(t.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")))
