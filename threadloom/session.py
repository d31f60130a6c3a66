"""A Spark session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, name: str = "threadloom") -> SparkSession:
    """Adaptive execution on, UTC, Arrow on; master and partitions are the cluster's own unless given."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
