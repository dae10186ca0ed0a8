"""A session with the settings the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: small shuffle partitions are merged, skewed ones split,
    # joins turn into broadcasts where a side proves small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where the aggregation after a join then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Day and hour of a timestamp column are those of UTC.
    "spark.sql.session.timeZone": "UTC",
    # Building a plan does not record the Python line of every column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(name: str = "badgewright", **settings: str) -> SparkSession:
    """Get or build a session; master, memory and parallelism come from the launcher."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
