"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quern", **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; anything else, such as partition counts, by ``conf`` or the cluster's defaults."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
