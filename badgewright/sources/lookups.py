"""Lookups of fixed size (18 rows each): as relations to join, and as expressions.

The expression is a constant map. It needs no join and disappears with the column
when nobody reads it. The relation is small at any scale, so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from badgewright.fixed import POSTAL_DISTRICTS, PROVINCES
from badgewright.functions.labels import col_of, postal_initial
from badgewright.operators.joins import enrich


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_rows(spark: SparkSession, rows: Iterable[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """A constant relation of texts, whose size Spark knows."""
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS literal_rows({', '.join(names)})")


def provinces(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, PROVINCES, ["province_postcode", "province_code", "province"])


def looked_up(key: Column | str, pairs: Iterable[tuple[str, str]]) -> Column:
    """Value of the key in a constant map, NULL where it is not there."""
    entries = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in pairs)
    return F.element_at(F.expr(f"map({entries})"), col_of(key))


def province_name(initial: Column | str) -> Column:
    return looked_up(initial, [(key, name) for key, _, name in PROVINCES])


def postal_district(postal_code: Column | str) -> Column:
    return looked_up(postal_initial(postal_code), POSTAL_DISTRICTS)


def with_province(df: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Add province code and name by ``province_postcode``; unknown initials get NULL.

    ``lookup`` may be a table of one's own in place of the fixed one.
    """
    if lookup is not None:
        return enrich(df, lookup, "province_postcode", "left")
    return df.join(F.broadcast(provinces(df.sparkSession)), "province_postcode", "left")
