"""Positions, running sums and pages in a total order, over any number of rows.

A window without partitions runs in one task. Here the rows are sorted by range partitions and written once; each
part is summed by itself, and the parts' totals, of which there are as many as parts, are added up
as offsets. No task sees more than its part and the totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from badgewright.fixed import DEFAULT_PAGE_ROWS
from badgewright.sources.files import materialised, read_snapshot

PART, ROW = "_part", "_row"
# monotonically_increasing_id: the part in the upper bits, the row of the part in the lower 33.
_ROW_BITS = 33


def _ordered(df: DataFrame, by: Sequence[str | Column], parts: int | None) -> DataFrame:
    """Rows in range partitions, with their part and their place in it.

    Rows that are equal in ``by`` would all go to one part; a hash of the whole row as the last key spreads those that
    differ elsewhere.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keys = [*[F.col(f"`{c}`") if isinstance(c, str) else c for c in by], spread]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    at = F.monotonically_increasing_id()
    return dealt.sortWithinPartitions(*keys).withColumns(
        {PART: F.shiftright(at, _ROW_BITS).cast("int"), ROW: at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}
    )


def _offsets(parts: DataFrame, total: Column) -> DataFrame:
    """(part, before): the sum of ``total`` over all earlier parts. One row per part."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(PART).agg(total.alias("_total"))
    return sums.select(PART, F.coalesce(F.sum("_total").over(before), F.lit(0).cast("bigint")).alias("_before"))


def positions(df: DataFrame, by: Sequence[str | Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """The rows with their position, from 1, in the order of ``by``. Equal rows follow each other in any order.

    ``parts`` is the number of range partitions (default: the session's, merged where they are small).
    """
    held = materialised(_ordered(df, by, parts), "positions")
    offsets = F.broadcast(_offsets(held, F.count(F.lit(1))))
    placed = held.join(offsets, PART).withColumn(name, F.col("_before") + F.col(ROW) + 1)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], name)


def running_sum(
    df: DataFrame, by: Sequence[str | Column], value: str, name: str = "running", parts: int | None = None
) -> DataFrame:
    """The rows with the sum of ``value`` over all rows up to theirs in the order of ``by``.

    ``value`` is a whole number (a running sum of floating point numbers depends on the order of addition). NULL adds
    nothing. ``by`` should tell rows apart; rows that are equal in it are ordered by a hash.
    """
    held = materialised(_ordered(df, by, parts), "running")
    amount = F.coalesce(F.col(f"`{value}`"), F.lit(0)).cast("bigint")
    offsets = F.broadcast(_offsets(held, F.sum(amount)))
    inside = Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = held.withColumn("_inside", F.sum(amount).over(inside))
    placed = summed.join(offsets, PART).withColumn(name, F.col("_before") + F.col("_inside"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], name)


def running_total(df: DataFrame, key: str, value: str, name: str = "running", parts: int | None = None) -> DataFrame:
    """One row per ``key``: the sum of ``value`` and the running sum over all keys up to it.

    Rows are summed per key before they are dealt out, so a key that holds most of the rows is one row here.
    """
    sums = df.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(value))
    return running_sum(sums, [F.col(f"`{key}`").asc_nulls_first()], value, name, parts)


@dataclass(frozen=True)
class Pages:
    """A report kept in order: below ``path``, a folder of rows per part, and an index of the rows before each part."""

    spark: SparkSession
    path: str
    schema: T.StructType | None = None

    @property
    def _rows(self) -> str:
        return f"{self.path}/rows"

    @property
    def _index(self) -> str:
        return f"{self.path}/index"

    def page(self, number: int, rows: int | None = None) -> DataFrame:
        """Page ``number``, from 1. Only the parts that hold its rows are read, and of them only its rows kept.

        The index answers which parts these are: the driver sees those alone. A page behind the last one is empty.
        """
        rows = DEFAULT_PAGE_ROWS if rows is None else rows
        first = (number - 1) * rows
        index = read_snapshot(self.spark, self._index)
        here = index.where((F.col("_before") < first + rows) & (F.col("_before") + F.col("_n") > first)).collect()
        kept = read_snapshot(self.spark, self._rows, self.schema).where(F.col(PART).isin([part[PART] for part in here]))
        wanted = F.lit(False)
        for part in here:
            low = first - part["_before"]
            wanted = wanted | ((F.col(PART) == part[PART]) & F.col(ROW).between(max(low, 0), low + rows - 1))
        return kept.where(wanted).orderBy(PART, ROW).drop(PART, ROW)

    def count(self) -> DataFrame:
        """One row: how many rows all pages have."""
        return read_snapshot(self.spark, self._index).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def write_pages(df: DataFrame, by: Sequence[str | Column], path: str, parts: int | None = None) -> Pages:
    """Sort a report once and keep it so that any page is read from one or two of its parts.

    The first page costs the sort; every other one, however deep, a look at the index and a page of one part.
    """
    places = [T.StructField(PART, T.IntegerType()), T.StructField(ROW, T.LongType())]
    pages = Pages(df.sparkSession, path, T.StructType([*df.schema.fields, *places]))
    _ordered(df, by, parts).write.mode("overwrite").partitionBy(PART).parquet(pages._rows)
    held = read_snapshot(df.sparkSession, pages._rows, pages.schema)
    counted = held.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")))
    counted.coalesce(1).write.mode("overwrite").parquet(pages._index)
    return pages
