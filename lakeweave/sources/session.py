"""Session settings that the library's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lakeweave", **settings: str) -> SparkSession:
    """A UTC session with adaptive execution; ``settings`` are further Spark settings."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | settings
    builder = SparkSession.builder.appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
