"""Presentation of a report: text columns and pages."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from badgewright.fixed import DEFAULT_PAGE_ROWS
from badgewright.functions.numbers import percent_text


def paired_columns(df: DataFrame, percents: Collection[str] = ()) -> DataFrame:
    """Every column twice: ``c_rank`` to be shown (percentages as text), ``c`` to sort by."""
    shown = [percent_text(c) if c in percents else F.col(c) for c in df.columns]
    return df.select(*[x for c, s in zip(df.columns, shown) for x in (s.alias(f"{c}_rank"), F.col(c))])


def page(df: DataFrame, by: Sequence[str | Column], number: int = 1, rows: int | None = None) -> DataFrame:
    """Page ``number`` (from 1) of a report in a total order.

    Offset and limit over a sort become a top-k: each task keeps at most the rows
    up to the end of the page.
    """
    rows = DEFAULT_PAGE_ROWS if rows is None else rows
    return df.orderBy(*by).offset((number - 1) * rows).limit(rows)
