"""Spark settings that suit the reports."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates are compared with the report day, so all tasks must agree on the zone.
    "spark.sql.session.timeZone": "UTC",
    # Run-time partition sizes, and large partitions of a shuffle join split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lookups and queues are checkpointed; files of those no longer in use are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # The JVM never compiles methods above 8000 bytes; below that Spark splits them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """``builder`` with the settings; masters, memory and partitions stay the caller's."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
