"""Row filters of the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Day = Column | str


def as_date(day) -> Column:
    return (day if isinstance(day, Column) else F.lit(day)).cast("date")


def in_days(date: Column | str, first: Day, last: Day, shift: int = 0) -> Column:
    """Condition: the date lies in ``first`` to ``last``, both moved back by ``shift`` days."""
    d = F.col(date) if isinstance(date, str) else date
    low, high = as_date(first), as_date(last)
    if shift:
        low, high = F.date_sub(low, shift), F.date_sub(high, shift)
    return d.between(low, high)


def date_range(df: DataFrame, first: Day, last: Day, date: str = "date") -> DataFrame:
    return df.where(in_days(date, first, last))


def dim_filter(df: DataFrame, filters: Mapping[str, str] | Sequence[str] | None) -> DataFrame:
    """Keep rows equal to every wanted value; a value starting with ``All`` filters nothing.

    ``filters`` maps column to value, or lists them in turn: column, value, column, value.
    """
    if not filters:
        return df
    pairs = list(filters.items() if isinstance(filters, Mapping) else zip(filters[::2], filters[1::2], strict=True))
    types = dict(df.dtypes)
    unknown = [c for c, _ in pairs if c not in types]
    if unknown:
        raise ValueError(f"no such filter column: {', '.join(unknown)}")
    wanted = [_equals(c, types[c], str(v)) for c, v in pairs if not str(v).startswith("All")]
    return df.where(reduce(Column.__and__, wanted)) if wanted else df


def _equals(column: str, dtype: str, value: str) -> Column:
    """Compare in the column's own type, so that the predicate reaches the scan."""
    if dtype == "string":
        return F.col(column) == value
    return F.col(column) == F.lit(value).try_cast(dtype)


def label_in(df: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(list(labels)))
