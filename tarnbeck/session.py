"""The session that all stages run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str, **conf: str) -> SparkSession:
    """A session in UTC, so that days are the same on every host; ANSI semantics stay on, and
    text that may not parse goes through try_ functions."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
