"""The social projection: users, messages, links and explicit edges read from the ``events`` table.

A purchase replies to an earlier event, an error shares one, a click addresses a user directly, a view addresses
nobody, and a signup declares an explicit edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS, WEEK_START = 5, "1970-01-05"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_users(events: DataFrame) -> DataFrame:
    return events.agg((F.max("user_id") + 1).alias("n"))  # one row


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k (from props) and n, the number of users."""
    events = table(spark, sf_dir, "events")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("long")).crossJoin(F.broadcast(n_users(events)))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, is_core."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().withColumn("is_core", F.col("id") % 5 != 0)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sender, ts, event_type, k, other, topic, parent_id."""
    e = projected(spark, sf_dir).where("event_type <> 'signup'")
    parent = F.when(F.col("event_type").isin("purchase", "error") & (F.col("event_id") > 0), F.greatest(F.col("event_id") - 1 - F.col("k") % 10, F.lit(0)))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("sender"), "ts", "event_type", "k", (F.col("k") % F.col("n")).alias("other"),
        F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(TOPICS)).alias("topic"), parent.cast("long").alias("parent_id"))


def explicit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (follower), dst (followed), without loops and doubles."""
    e = projected(spark, sf_dir).where("event_type = 'signup'")
    return e.select(F.col("user_id").alias("src"), (F.col("k") % F.col("n")).alias("dst")).where("src <> dst").distinct()


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communication graph of replies: src (sender), dst (addressed)."""
    return messages(spark, sf_dir).where("event_type = 'purchase' AND other <> sender").select(F.col("sender").alias("src"), F.col("other").alias("dst")).distinct()


#: The same in DuckDB's SQL, to put before an oracle's SELECT.
SQL = """
nu AS (SELECT max(user_id) + 1 AS n FROM events),
ev AS (SELECT e.*, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, n FROM events e, nu),
users AS (SELECT DISTINCT user_id AS id, user_id % 5 <> 0 AS is_core FROM events),
messages AS (SELECT event_id AS id, user_id AS sender, ts, event_type, k, k % n AS other, CAST(round(value * 100) AS BIGINT) % 5 AS topic,
  CASE WHEN event_type IN ('purchase', 'error') AND event_id > 0 THEN greatest(event_id - 1 - (k % 10), 0) END AS parent_id FROM ev WHERE event_type <> 'signup'),
classified AS (SELECT *, CASE WHEN event_type = 'purchase' AND other <> sender THEN 'ADDR' WHEN event_type = 'error' AND other <> sender THEN 'SHARED'
  WHEN event_type = 'click' AND other <> sender THEN 'ADDR' ELSE 'NON_ADDR' END AS cls FROM messages),
explicit_edges AS (SELECT DISTINCT user_id AS src, k % n AS dst FROM ev WHERE event_type = 'signup' AND user_id <> k % n),
purchase_edges AS (SELECT DISTINCT sender AS src, other AS dst FROM messages WHERE event_type = 'purchase' AND other <> sender)
"""


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """An oracle: the projection, further common table expressions and a SELECT."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([SQL.strip(), *ctes]) + "\n" + body
