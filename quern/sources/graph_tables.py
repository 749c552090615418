"""Node and edge tables of a social graph in a shared folder, and views of a source by its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import social

PARTS = 16


def part(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (id, ...) by id, edges (src, dst, is_explicit, ...) by source and again by target: either way round is one folder."""
    nodes.withColumn("part", part("id")).repartition("part").sortWithinPartitions("id").write.partitionBy("part").parquet(f"{path}/nodes")
    edges.withColumn("part", part("src")).repartition("part").sortWithinPartitions("src", "dst").write.partitionBy("part").parquet(f"{path}/edges")
    edges.withColumn("part", part("dst")).repartition("part").sortWithinPartitions("dst", "src").write.partitionBy("part").parquet(f"{path}/reverse")


def read_nodes(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """All nodes, or those of ``ids`` (id); the folders of other ids are not read."""
    nodes = spark.read.parquet(f"{path}/nodes")
    return (nodes if ids is None else nodes.join(ids.select("id", part("id")), ["id", "part"], "left_semi")).drop("part")


def read_edges(spark: SparkSession, path: str, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """All edges, the out-edges of ``sources`` (id) or the in-edges of ``targets`` (id)."""
    by, key, ids = ("reverse", "dst", targets) if targets is not None else ("edges", "src", sources)
    edges = spark.read.parquet(f"{path}/{by}")
    return (edges if ids is None else edges.join(ids.select(F.col("id").alias(key), part("id")), [key, "part"], "left_semi")).drop("part")


def has_explicit_edges(spark: SparkSession, path: str) -> bool:
    return bool(spark.read.parquet(f"{path}/edges").where("is_explicit").limit(1).count())


def replies_first(spark: SparkSession, d: str) -> DataFrame:
    from quern.operators.messages import classified

    return classified(spark, d)


def reposts_first(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a source that has recipient lists: views go to two users, a group of more than one addresses nobody."""
    from quern.operators.messages import classify_repost_first

    m = social.messages(spark, d)
    rec = F.when(F.col("event_type") == "view", F.array("other", "k")).otherwise(F.array("other"))
    return m.withColumn("cls", classify_repost_first(F.col("sender") + 1, F.when(F.col("event_type") == "error", F.col("other") + 1), F.transform(rec, lambda x: x + 1), 1))


#: Loaders of messages by the kind of source.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"replies": replies_first, "groups": reposts_first}


def register(spark: SparkSession, d: str, kind: str) -> None:
    """Temporary views of the source: <kind>_messages, <kind>_users, <kind>_edges."""
    if kind not in SOURCES:
        raise KeyError(f"no source {kind}: {', '.join(sorted(SOURCES))}")
    SOURCES[kind](spark, d).createOrReplaceTempView(f"{kind}_messages")
    social.users(spark, d).createOrReplaceTempView(f"{kind}_users")
    social.explicit_edges(spark, d).createOrReplaceTempView(f"{kind}_edges")
