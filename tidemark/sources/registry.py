"""Sources and the schema version in force on a day."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import SCHEMA_VERSION, SOURCE_REGISTRY


def load_registry(spark: SparkSession, toml: str) -> tuple[DataFrame, DataFrame]:
    """(sources, schema versions) of a TOML text with ``[[source]]`` entries and their ``schema_version`` spans."""
    sources = tomllib.loads(toml).get("source", [])
    rows = [tuple(str(s[f.name]) if f.name == "requests_per_second" else s.get(f.name) for f in SOURCE_REGISTRY) for s in sources]
    versions = [(s["source_id"], v["effective_from"], v["version"], v.get("effective_to")) for s in sources for v in s.get("schema_version", [])]
    ddl = ", ".join(f"{f.name} {'string' if f.name == 'requests_per_second' else f.dataType.simpleString()}" for f in SOURCE_REGISTRY)
    return spark.createDataFrame(rows, ddl).withColumn("requests_per_second", F.col("requests_per_second").cast("decimal(6,3)")), spark.createDataFrame(versions, SCHEMA_VERSION)


def with_schema_version(days: DataFrame, versions: DataFrame, day: str = "trade_date") -> DataFrame:
    """``days`` (source_id, day) with the version whose span holds the day, both ends included; the first by start.

    Days outside every span keep a null version: see ``unmapped``.
    """
    v = versions.select(F.col("source_id").alias("_s"), "effective_from", "effective_to", "version")
    on = (F.col("source_id") == F.col("_s")) & (F.col(day) >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col(day) <= F.col("effective_to")))
    return days.join(v, on, "left").groupBy("source_id", day).agg(F.min_by("version", "effective_from").alias("version"))


def unmapped(versioned: DataFrame) -> DataFrame:
    return versioned.where("version IS NULL")
