"""A fact kept by day, of which a new load rewrites only the days that changed.

Below ``root`` lie

    data/load=<k>/day=<d>/...      what load k wrote, for the days that it wrote
    manifest/version=<k>/...       one row per day: the load that holds it, and a fingerprint of the source rows it was built from

A load compares the fingerprints of the source's days with the last manifest, builds and writes the days that differ under a
number of its own, and then writes the next manifest. A manifest counts once Spark's commit marker is in its folder, so
readers see the old state until that moment and the new one from then on; a load that breaks off leaves files that
no manifest names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from badgewright.sources.files import write_snapshot

DAY, LOAD = "day", "load"
_COMMITTED = "_SUCCESS"
_MANIFEST = "day date, load int, rows bigint, low bigint, high bigint"


def settled(daily: DataFrame, intraday: DataFrame, day: str = "event_date") -> DataFrame:
    """Finished daily shards and, of the intraday ones, the days that have no finished shard yet.

    A day's finished shard takes the place of its intraday one: the two are never mixed.
    """
    finished = daily.select(F.col(day).alias("_finished")).distinct()
    open_days = intraday.join(finished, F.col(day) == F.col("_finished"), "left_anti")
    return daily.unionByName(open_days)


def day_fingerprints(source: DataFrame, day: str) -> DataFrame:
    """Per day: rows, and two sums of row hashes, which do not depend on the order of the rows.

    Rows are hashed as they are read and summed per task before they meet, so a day that holds most rows is no hot spot.
    """
    h = F.xxhash64(*[F.col(f"`{c}`") for c in source.columns])
    half = F.lit(1 << 32)
    return source.where(F.col(day).isNotNull()).groupBy(F.col(day).cast("date").alias(DAY)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.pmod(h, half)).alias("low"),
        F.sum(F.pmod(F.xxhash64(h, F.lit(1)), half)).alias("high"),
    )


@dataclass(frozen=True)
class Load:
    """What a refresh did: its version, and the days that were built, kept and dropped."""

    version: int
    built: tuple
    kept: tuple
    dropped: tuple


@dataclass(frozen=True)
class DayStore:
    """A fact by day below ``root``, a folder that all executors share. ``schema`` is the fact's, ``day`` its column of days."""

    spark: SparkSession
    root: str
    schema: T.StructType
    day: str = "event_date"

    def _files(self, path: str):
        """The store's Hadoop file system and a path in it: the folder may be in any store Spark writes to."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self, folder: str, name: str, committed: bool) -> list[int]:
        store, where = self._files(f"{self.root}/{folder}")
        if not store.exists(where):
            return []
        found = []
        for status in store.listStatus(where):
            path = status.getPath()
            key, _, number = path.getName().partition("=")
            if key == name and number.isdigit() and (not committed or store.exists(path.suffix(f"/{_COMMITTED}"))):
                found.append(int(number))
        return sorted(found)

    def version(self) -> int:
        """The number of the last committed manifest, 0 before the first load."""
        return max(self._numbers("manifest", "version", True), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row per day of the fact: the load that holds it and the fingerprint of its source."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/version={version}")

    def refresh(self, source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> Load:
        """Bring the fact to the state of ``source``: build the days that are new or differ, drop those that went.

        ``build`` makes the fact of some days of the source; it must keep the day and make each day's rows from that
        day's source rows alone. Rows without a day are in no day. The driver sees one row per day.
        """
        day = self.day
        now = day_fingerprints(source, day)
        before = {r[DAY]: r for r in self.manifest().collect()}
        seen = {r[DAY]: r for r in now.collect()}
        same = {d for d, r in seen.items() if d in before and all(r[c] == before[d][c] for c in ("rows", "low", "high"))}
        changed = sorted(seen.keys() - same)
        dropped = sorted(before.keys() - seen.keys())
        if not changed and not dropped:
            return Load(self.version(), (), tuple(sorted(same)), ())
        taken = self._numbers("data", LOAD, False) + self._numbers("manifest", "version", False)
        version = max(taken, default=0) + 1
        if changed:
            fact = build(source.where(F.col(day).cast("date").isin(changed)))
            kept = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema if f.name != day]
            fact = fact.select(*kept, F.col(day).cast("date").alias(DAY))
            write_snapshot(fact, f"{self.root}/data/{LOAD}={version}", by=DAY)
        rows = [(d, before[d][LOAD] if d in same else version, r["rows"], r["low"], r["high"]) for d, r in sorted(seen.items())]
        listed = self.spark.createDataFrame(rows, _MANIFEST)
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/version={version}")
        return Load(version, tuple(changed), tuple(sorted(same)), tuple(dropped))

    def read(self, first: Column | str | None = None, last: Column | str | None = None, version: int | None = None) -> DataFrame:
        """The fact as the last committed manifest (or an earlier one) has it, of all days or of ``first`` to ``last``.

        Only the folders that the manifest names are read; the range prunes them further.
        """
        by_load: dict[int, list] = {}
        for row in self.manifest(version).collect():
            by_load.setdefault(row[LOAD], []).append(row[DAY])
        if not by_load:
            return self.spark.createDataFrame([], self.schema)
        folders = [T.StructField(LOAD, T.IntegerType()), T.StructField(DAY, T.DateType())]
        stored = T.StructType([f for f in self.schema if f.name != self.day] + folders)
        held = self.spark.read.schema(stored).parquet(f"{self.root}/data")
        named = F.lit(False)
        for load, days in sorted(by_load.items()):
            named = named | ((F.col(LOAD) == load) & F.col(DAY).isin(days))
        fact = held.where(named)
        if first is not None:
            fact = fact.where(F.col(DAY) >= (first if isinstance(first, Column) else F.lit(first)).cast("date"))
        if last is not None:
            fact = fact.where(F.col(DAY) <= (last if isinstance(last, Column) else F.lit(last)).cast("date"))
        return fact.select(*[(F.col(DAY) if f.name == self.day else F.col(f"`{f.name}`")).alias(f.name) for f in self.schema])

    def remove_unnamed(self) -> list[int]:
        """Delete the loads that the last manifest does not name, and earlier manifests. Earlier versions end here."""
        version = self.version()
        named = {r[LOAD] for r in self.manifest(version).collect()}
        gone = [k for k in self._numbers("data", LOAD, False) if k not in named and k <= version]
        for folder in [f"data/{LOAD}={k}" for k in gone] + [
            f"manifest/version={k}" for k in self._numbers("manifest", "version", False) if k < version
        ]:
            store, where = self._files(f"{self.root}/{folder}")
            store.delete(where, True)
        return gone
