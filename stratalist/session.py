"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "stratalist", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
