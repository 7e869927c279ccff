"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "terrace", **conf: str) -> SparkSession:
    """UTC, adaptive plans and Arrow; everything else is left to the cluster's own settings or to ``conf``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
