"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.operators import evaluation, graphs, messages, models, neighbourhood, storage, text, theta, topics, vector_queries, windows

MODULES = (messages, theta, windows, graphs, models, neighbourhood, text, storage, vector_queries, evaluation, topics)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["top_edges"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, (_, s) in m.QUERIES.items() if s}
