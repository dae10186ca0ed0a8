"""Relative periods, as column expressions of a reference day.

With a constant reference day (``current_date()`` or a literal) the bounds are
constants to Catalyst, so a filter on them still reaches the scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS_OF = {"m": ("month", 1), "q": ("quarter", 3), "y": ("year", 12)}


class Period(NamedTuple):
    start: Column
    end: Column
    cmp_start: Column
    cmp_end: Column


def period(code: str, as_of: Column | None = None, compare: str = "None") -> Period:
    """Bounds of a period code and of the period it is compared with.

    Codes: ``m q y`` this month, quarter, year; ``w`` this week; with ``p`` the one
    before; a number: that many days up to yesterday. ``compare`` starting with N
    or P takes the period just before, anything else the same period a year ago.
    """
    day = F.current_date() if as_of is None else as_of
    before = compare.startswith(("N", "P"))
    previous = code.endswith("p")
    unit = code[:1]

    if unit in MONTHS_OF:
        name, months = MONTHS_OF[unit]
        start = F.trunc(day, name).cast("date")
        if previous:
            start = F.add_months(start, -months)
        cmp_start = F.add_months(start, -months if before else -12)
        return Period(start, _months_end(start, months), cmp_start, _months_end(cmp_start, months))

    if unit == "w":
        # Monday of the week that starts on Sunday: on a Sunday that is tomorrow.
        start = F.date_add(day, F.lit(2 - 7 * previous) - F.dayofweek(day))
        days = 7
        end = F.date_add(start, days - 1)
    elif code.isdigit():
        days = int(code)
        start = F.date_sub(day, days)
        end = F.date_sub(day, 1)
    else:
        raise ValueError(f"no such period code: {code}")
    cmp_start = F.date_sub(start, days) if before else F.add_months(start, -12)
    return Period(start, end, cmp_start, F.date_add(cmp_start, days - 1))


def _months_end(start: Column, months: int) -> Column:
    return F.date_sub(F.add_months(start, months), 1)
