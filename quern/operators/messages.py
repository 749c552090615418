"""Messages: classification, restriction, links, slices and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources import social
from quern.sources.social import sql

ADDR, NON_ADDR, SHARED = "ADDR", "NON_ADDR", "SHARED"


def classify_reply_first(sender: Column, reply_to: Column, repost_of: Column) -> Column:
    """A reply to another user addresses; else a repost of another user shares; else nobody is addressed."""
    return F.when(reply_to.isNotNull() & (reply_to != 0) & (reply_to != sender), ADDR).when(repost_of.isNotNull() & (repost_of != 0) & (repost_of != sender), SHARED).otherwise(NON_ADDR)


def classify_repost_first(sender: Column, repost_of: Column, recipients: Column, group: int) -> Column:
    """A repost of another user shares; no recipients but the sender, or more than ``group``, is not addressed; else it is."""
    others = F.array_remove(F.coalesce(recipients, F.array().cast("array<bigint>")), sender)
    return F.when(repost_of.isNotNull() & (repost_of != 0) & (repost_of != sender), SHARED).when((F.size(others) == 0) | (F.size(others) > group), NON_ADDR).otherwise(ADDR)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = social.messages(spark, sf_dir)
    t, other, sender = F.col("event_type"), F.col("other"), F.col("sender")
    # Ids start at 0 here and 0 means none to the classifier: shift them.
    return m.withColumn("cls", classify_reply_first(sender + 1, F.when(t.isin("purchase", "click"), other + 1), F.when(t == "error", other + 1)))


def with_recipients(m: DataFrame) -> DataFrame:
    """Recipients as an array; a message that addresses nobody is sent to its sender."""
    return m.withColumn("recipients", F.when(F.col("cls") == ADDR, F.array("other")).otherwise(F.array("sender")))


def restrict(m: DataFrame, members: DataFrame) -> DataFrame:
    """Keep recipients who are members (id, is_core); drop messages without any, or without a core user on either side."""
    r = m.withColumn("recipient", F.explode("recipients")).join(members.select(F.col("id").alias("recipient"), F.col("is_core").alias("_rc")), "recipient")
    r = r.join(members.select(F.col("id").alias("sender"), F.col("is_core").alias("_sc")), "sender", "left")
    g = r.groupBy("id", "sender").agg(F.sort_array(F.collect_set("recipient")).alias("recipients"), F.max(F.col("_rc") | F.coalesce("_sc", F.lit(False))).alias("_core"))
    return g.where("_core").drop("_core")


def in_slice(ts: Column, start: Column, end: Column) -> Column:
    """Slices are open at their start and closed at their end."""
    return (ts > start) & (ts <= end)


def links(m: DataFrame) -> DataFrame:
    """child, parent (null if it is not there), incomplete; children earlier than their parent are dropped."""
    p = m.select(F.col("id").alias("parent"), F.col("ts").alias("_pts"))
    child = m.where("parent_id IS NOT NULL").select(F.col("id").alias("child"), "ts", "parent_id")
    j = child.join(p, child["parent_id"] == p["parent"], "left")
    return j.where("_pts IS NULL OR ts >= _pts").select("child", "parent", F.col("parent").isNull().alias("incomplete"))


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# Queries ----------------------------------------------------------------------------------------------------------


def msg_classify(spark, d):
    return classified(spark, d).groupBy("cls", "topic").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def msg_classify_group(spark, d):
    m = social.messages(spark, d)
    rec = F.when(F.col("event_type") == "view", F.array(F.col("other"), F.col("k"))).otherwise(F.array("other"))
    cls = classify_repost_first(F.col("sender") + 1, F.when(F.col("event_type") == "error", F.col("other") + 1), F.transform(rec, lambda x: x + 1), 1)  # user 0 is no missing user
    return m.select(cls.alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


def msg_restrict(spark, d):
    linked = social.explicit_edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id"))
    r = restrict(with_recipients(classified(spark, d).where("cls <> 'SHARED'")), social.users(spark, d).join(linked, "id", "left_semi"))
    return r.select("id", "sender", F.element_at("recipients", 1).alias("recipient"))


def parent_sender(spark, d):
    m = social.messages(spark, d)
    p = m.select(F.col("id").alias("parent_id"), F.col("sender").alias("parent_sender"))
    return m.where("parent_id IS NOT NULL AND ts >= TIMESTAMP_NTZ '2024-01-08' AND ts < TIMESTAMP_NTZ '2024-01-15'").join(p, "parent_id", "left").select("id", "parent_id", "parent_sender")


def recipients(spark, d):
    m = classified(spark, d).where("cls = 'ADDR'")
    return m.groupBy("sender").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_set("other")), lambda x: x.cast("string"))).alias("recipients"))


def user_adjacency(spark, d):
    e = social.explicit_edges(spark, d)
    both = e.union(e.select("dst", "src")).distinct()
    return social.users(spark, d).join(both, F.col("id") == F.col("src"), "left").groupBy("id").agg(F.count("dst").alias("degree"))


def screen_names(spark, d):
    u = social.users(spark, d).withColumn("name", F.concat(F.lit("u"), F.col("id") % 100))
    w = Window.partitionBy("name").orderBy("id")
    return u.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", "id")


def core_users(spark, d):
    return social.users(spark, d).where("is_core").select("id")


def text_or_original(spark, d):
    m = classified(spark, d)
    o = m.select(F.col("id").alias("parent_id"), F.col("event_type").alias("otext"))
    return m.where("event_type = 'error'").join(o, "parent_id", "left").select("id", F.coalesce("otext", "event_type").alias("text"))


def symmetric_anti(spark, d):
    e = social.explicit_edges(spark, d)
    r = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(r, ["src", "dst"], "left_anti")


def reply_links(spark, d):
    return links(social.messages(spark, d))


def snowflake_time(ident: Column, sent: Column) -> Column:
    """The millisecond time in ids that hold one, else the time that was sent."""
    return F.when(ident > 419430400000, F.lit(1288834974657) + F.shiftright(ident, 22)).otherwise(F.floor(epoch(sent) / 1000))


def snowflake(spark, d):
    e = social.table(spark, d, "events").withColumn("sid", F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 4194304000 + 500000000000).otherwise(F.col("event_id")))
    return e.select("event_id", snowflake_time(F.col("sid"), F.col("ts")).cast("long").alias("millis"))


def activity_stats(spark, d):
    m = classified(spark, d).where("cls = 'ADDR'").withColumn("inw", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    edges = m.groupBy("sender", "other").agg(F.max("inw").alias("inw"))
    node = edges.select(F.explode(F.array("sender", "other")).alias("v"), "inw").groupBy("v").agg(F.max("inw").alias("inw"))
    ex = social.explicit_edges(spark, d)
    out = edges.join(ex, (edges["sender"] == ex["src"]) & (edges["other"] == ex["dst"]), "left_anti")
    n = node.agg(F.count("*").alias("nodes"), F.count_if("inw").alias("nodes_window"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if("inw").alias("edges_window"))
    return n.crossJoin(e).crossJoin(out.agg(F.count("*").alias("edges_not_explicit")))  # one row each


def message_stats(spark, d):
    m = classified(spark, d)
    per = m.groupBy("sender").agg(F.count("*").alias("n"), F.count_if(F.col("cls") == ADDR).alias("a"), F.count_if(F.col("cls") == SHARED).alias("s"))
    r = per.select("n", "a", "s", (F.col("a") / F.col("n")).alias("ra"))
    return r.agg(F.sum("n").alias("messages"), F.sum("a").alias("addressive"), F.sum(F.col("n") - F.col("a")).alias("non_addressive"), F.sum("s").alias("shared"),
        F.round(F.avg("ra"), 6).alias("mean_ratio"), F.round(F.coalesce(F.stddev_samp("ra"), F.lit(0.0)), 6).alias("sd_ratio"))


def volume_histo(spark, d):
    e = social.table(spark, d, "events").where("NOT (second(ts) = 0 AND minute(ts) IN (0, 30))")
    x = e.select(F.year("ts").alias("y"), (F.month("ts") - 1).alias("m"), F.dayofweek("ts").alias("dow"), F.hour("ts").alias("h"))
    g = x.groupingSets([["y", "m"], ["m"], ["dow"], ["h"]], "y", "m", "dow", "h").agg(F.count("*").alias("n"))
    return g


def token_stats(spark, d):
    t = social.table(spark, d, "documents").select(F.size(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")).alias("n"))
    return t.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("sd"), F.percentile("n", F.lit(0.5)).alias("median"))


def event_days(spark, d):
    e = social.table(spark, d, "events")
    days = e.select(F.to_date("ts").alias("s"), F.date_add(F.to_date("ts"), (F.col("event_id") % 3).cast("int")).alias("t"))
    return days.select(F.explode(F.sequence("s", "t")).alias("day")).groupBy("day").agg(F.count("*").alias("n")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def backdated(spark, d):
    return social.table(spark, d, "events").where("second(ts) = 0 AND minute(ts) IN (0, 30)").select("event_id")


def event_type_counts(spark, d):
    m = classified(spark, d)
    return m.groupBy("event_type", "cls").agg(F.count("*").alias("n"), F.countDistinct("sender").alias("senders"))


C = "c AS (SELECT * FROM classified)"
QUERIES = {
    "msg_classify": (msg_classify, sql("SELECT cls, topic, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM classified GROUP BY ALL")),
    "msg_classify_group": (msg_classify_group, sql("""SELECT cls, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' AND other <> sender THEN 'SHARED'
      WHEN len(list_filter(CASE WHEN event_type = 'view' THEN [other, k] ELSE [other] END, lambda x: x <> sender)) NOT BETWEEN 1 AND 1 THEN 'NON_ADDR' ELSE 'ADDR' END AS cls FROM messages) GROUP BY 1""")),
    "msg_restrict": (msg_restrict, sql("""SELECT m.id, m.sender, m.r AS recipient FROM (SELECT id, sender, CASE WHEN cls = 'ADDR' THEN other ELSE sender END AS r FROM classified WHERE cls <> 'SHARED') m
      JOIN mb u ON u.id = m.r LEFT JOIN mb s ON s.id = m.sender WHERE u.is_core OR coalesce(s.is_core, false)""", "mb AS (SELECT * FROM users WHERE id IN (SELECT src FROM explicit_edges UNION SELECT dst FROM explicit_edges))")),
    "parent_sender": (parent_sender, sql("SELECT m.id, m.parent_id, p.sender AS parent_sender FROM messages m LEFT JOIN messages p ON p.id = m.parent_id WHERE m.parent_id IS NOT NULL AND m.ts >= TIMESTAMP '2024-01-08' AND m.ts < TIMESTAMP '2024-01-15'")),
    "recipients": (recipients, sql("SELECT sender, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS recipients FROM (SELECT DISTINCT sender, other FROM classified WHERE cls = 'ADDR') GROUP BY 1")),
    "user_adjacency": (user_adjacency, sql("SELECT id, count(dst) AS degree FROM users LEFT JOIN (SELECT src, dst FROM explicit_edges UNION SELECT dst, src FROM explicit_edges) e ON e.src = id GROUP BY 1")),
    "screen_names": (screen_names, sql("SELECT 'u' || (id % 100) AS name, min(id) AS id FROM users GROUP BY 1")),
    "core_users": (core_users, sql("SELECT id FROM users WHERE is_core")),
    "text_or_original": (text_or_original, sql("SELECT m.id, coalesce(o.event_type, m.event_type) AS text FROM classified m LEFT JOIN classified o ON o.id = m.parent_id WHERE m.event_type = 'error'")),
    "symmetric_anti": (symmetric_anti, sql("SELECT src, dst FROM explicit_edges e WHERE NOT EXISTS (SELECT 1 FROM explicit_edges r WHERE r.src = e.dst AND r.dst = e.src)")),
    "reply_links": (reply_links, sql("SELECT c.id AS child, p.id AS parent, p.id IS NULL AS incomplete FROM messages c LEFT JOIN messages p ON p.id = c.parent_id WHERE c.parent_id IS NOT NULL AND (p.ts IS NULL OR c.ts >= p.ts)")),
    "snowflake": (snowflake, "SELECT event_id, CASE WHEN sid > 419430400000 THEN 1288834974657 + (sid >> 22) ELSE epoch_us(ts) // 1000 END AS millis FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN event_id * 4194304000 + 500000000000 ELSE event_id END AS sid FROM events)"),
    "activity_stats": (activity_stats, sql("""SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE inw) AS nodes_window, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE inw) AS edges_window,
      (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM explicit_edges x WHERE x.src = e.sender AND x.dst = e.other)) AS edges_not_explicit""",
      "e AS (SELECT sender, other, bool_or(ts >= TIMESTAMP '2024-01-15') AS inw FROM classified WHERE cls = 'ADDR' GROUP BY 1, 2)",
      "n AS (SELECT v, bool_or(inw) AS inw FROM (SELECT sender AS v, inw FROM e UNION ALL SELECT other, inw FROM e) GROUP BY 1)")),
    "message_stats": (message_stats, sql("""SELECT CAST(sum(n) AS BIGINT) AS messages, CAST(sum(a) AS BIGINT) AS addressive, CAST(sum(n - a) AS BIGINT) AS non_addressive, CAST(sum(s) AS BIGINT) AS shared,
      round(avg(a / n), 6) AS mean_ratio, round(coalesce(stddev_samp(a / n), 0), 6) AS sd_ratio FROM (SELECT count(*) AS n, count(*) FILTER (cls = 'ADDR') AS a, count(*) FILTER (cls = 'SHARED') AS s FROM classified GROUP BY sender)""")),
    "volume_histo": (volume_histo, """SELECT CAST(y AS INTEGER) AS y, CAST(m AS INTEGER) AS m, CAST(dow AS INTEGER) AS dow, CAST(h AS INTEGER) AS h, count(*) AS n FROM (SELECT year(ts) AS y, month(ts) - 1 AS m, dayofweek(ts) + 1 AS dow, hour(ts) AS h
      FROM events WHERE NOT (second(ts) = 0 AND minute(ts) IN (0, 30))) GROUP BY GROUPING SETS ((y, m), (m), (dow), (h))"""),
    "token_stats": (token_stats, """SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS sd, quantile_cont(n, 0.5) AS median
      FROM (SELECT CAST(len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS INTEGER) AS n FROM documents)"""),
    "event_days": (event_days, "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT unnest(generate_series(CAST(ts AS DATE), CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER), INTERVAL 1 DAY)) AS day FROM events) GROUP BY 1"),
    "backdated": (backdated, "SELECT event_id FROM events WHERE second(ts) = 0 AND minute(ts) IN (0, 30)"),
    "event_type_counts": (event_type_counts, sql("SELECT event_type, cls, count(*) AS n, count(DISTINCT sender) AS senders FROM classified GROUP BY ALL")),
}
