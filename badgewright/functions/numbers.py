"""Guarded arithmetic and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from badgewright.fixed import NO_VALUE
from badgewright.functions.labels import col_of


def is_finite(x: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    d = col_of(x).cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def percent_of(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole as a double, NULL when whole is 0."""
    return F.try_divide(F.lit(100.0) * col_of(part), col_of(whole).cast("double"))


def ratio(x: Column | str, y: Column | str) -> Column:
    return F.try_divide(col_of(x).cast("double"), col_of(y).cast("double"))


def percent_diff(x: Column | str, y: Column | str) -> Column:
    """100 * (x - y) / y, NULL where either side is no number or y is 0."""
    a, b = col_of(x), col_of(y)
    return F.when(is_finite(a) & is_finite(b), percent_of(a - b, b))


def percent_text(x: Column | str) -> Column:
    """``12.3`` as ``12.30%``."""
    return F.concat(fixed_text(x), F.lit("%"))


def fixed_text(x: Column | str, digits: int = 2) -> Column:
    """Text with a fixed number of decimals, NULL for NULL (``format_string`` prints it)."""
    number = F.round(col_of(x).cast("double"), digits)
    return F.when(number.isNotNull(), F.format_string(f"%.{digits}f", number))


def percent_diff_text(x: Column | str, y: Column | str) -> Column:
    return F.coalesce(percent_text(percent_diff(x, y)), F.lit(NO_VALUE))


def safe_round(x: Column | str, digits: int = 2) -> Column:
    """Round; whatever is no number (a placeholder text too) counts as 0."""
    d = col_of(x).try_cast("double")
    return F.when(is_finite(d), F.round(d, digits)).otherwise(F.lit(0.0))


def thousands(x: Column | str) -> Column:
    return F.format_number(col_of(x), 0)
