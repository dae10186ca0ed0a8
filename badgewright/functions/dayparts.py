"""The three day-part rules. They differ on purpose: each belongs to one fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from badgewright.functions.labels import col_of


def badge_day_part(hour: Column | str) -> Column:
    """Evening from 18, Afternoon from 12, Morning from 6; the rest, unknown too, is Night."""
    h = col_of(hour)
    return (
        F.when(h >= 18, "Evening").when(h >= 12, "Afternoon").when(h >= 6, "Morning").otherwise("Night")
    )


def reward_day_part(hour: Column | str) -> Column:
    """Morning 6-11, Afternoon 12-16, Evening 17-21, Night 22-5; unknown stays unknown."""
    h = col_of(hour)
    return (
        F.when(h.between(6, 11), "Morning")
        .when(h.between(12, 16), "Afternoon")
        .when(h.between(17, 21), "Evening")
        .when(h.between(0, 23), "Night")
    )


def app_day_part(hour: Column | str, corrected: bool = False) -> Column:
    """Six-hour parts of the local day.

    By default each part carries the next part's label (0-5 is Morning), as the
    published numbers do; ``corrected=True`` starts the day with Night.
    """
    h = col_of(hour)
    first, second, third = (6, 12, 18) if corrected else (0, 6, 12)
    return (
        F.when(h < first, "Night").when(h < second, "Morning").when(h < third, "Afternoon").otherwise("Evening")
    )
