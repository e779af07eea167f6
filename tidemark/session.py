"""A session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """UTC dates, ANSI arithmetic, adaptive plans, and checkpoints that go with their frames; anything in ``conf`` (dots as double underscores) wins."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
