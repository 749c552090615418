"""Ordered operators: neighbours in a sequence, chains and gaps, slices, sessions, top-k, splits and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.messages import ADDR, classified, epoch, links
from quern.operators.tables import cut, ranked
from quern.operators.theta import weekly
from quern.sources import social
from quern.sources.social import sql


#: Rounds double the reach of a pointer: 40 pass any depth; links that go on are a cycle.
MOST_ROUNDS = 40


def neighbours(m: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    return m.withColumn("prev_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))


def roots(link: DataFrame) -> DataFrame:
    """node, root, depth for every node of the reply forest, by pointer doubling: rounds grow with the log of the depth.

    ``link``: child, parent (null: the parent is not there; the child is then the root of an incomplete chain).
    """
    tree = link.where("parent IS NOT NULL").select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).alias("depth"))
    heads = tree.select(F.col("up").alias("node")).join(tree.select("node"), "node", "left_anti").distinct().select("node", F.col("node").alias("up"), F.lit(0).alias("depth"))
    single = link.where("parent IS NULL").select(F.col("child").alias("node")).join(tree.select(F.col("up").alias("node")), "node", "left_anti").select("node", F.col("node").alias("up"), F.lit(0).alias("depth"))
    # Nodes whose pointer is at a root are done; only the others go on, and meet all. One table is written a round.
    done = cut(heads.unionByName(single))
    tops, cur = done.select(F.col("node").alias("up"), F.lit(True).alias("_top")), tree
    for _ in range(MOST_ROUNDS):
        seen = cut(cur.join(tops, "up", "left").select("node", "up", "depth", F.coalesce("_top", F.lit(False)).alias("_top")))
        left = seen.where("NOT _top").drop("_top")
        done = done.unionByName(seen.where("_top").drop("_top"))
        if not left.limit(1).count():
            return done.select("node", F.col("up").alias("root"), "depth")
        x, y = left.alias("x"), done.unionByName(left).alias("y")
        cur = x.join(y, F.col("x.up") == F.col("y.node")).select(F.col("x.node"), F.col("y.up"), (F.col("x.depth") + F.col("y.depth")).alias("depth"))
    raise ValueError("links form a cycle")


def fixed_slices(m: DataFrame, n: int, *keys: str) -> DataFrame:
    """Slices of n consecutive messages per key."""
    return m.withColumn("slice", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "id")) - 1) / n))


def time_bin(ts: Column, start: str, seconds: int) -> Column:
    """Bins (lo, hi] of fixed length counted from ``start``: the bin that ends at or after ts."""
    return F.ceil((epoch(ts) - epoch(F.lit(start).cast("timestamp_ntz"))) / (seconds * 1_000_000))


def dbscan_1d(m: DataFrame, factor: float, min_points: int, *keys: str) -> DataFrame:
    """Sessions in time per key: eps = mean gap * factor; a core has min_points points within eps, itself included.

    Adds ``session``, the number of sessions begun so far. Cores less than eps apart chain; a point that is no core joins the
    core before it, else the one after it, if within eps; else it is a session of its own. A range frame counts neighbours.
    """
    g, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_t", "id")
    s = m.withColumn("_t", epoch(F.col("ts")))
    s = s.withColumn("_eps", (F.max("_t").over(g) - F.min("_t").over(g)) / F.greatest(F.count("*").over(g) - 1, F.lit(1)) * factor)
    # A point is a core if min_points points lie within eps: some run of that many neighbours around it is narrow enough.
    narrow = F.lit(False)
    for back in range(min_points):
        a, b = F.lag("_t", back).over(order), F.lead("_t", min_points - 1 - back).over(order)
        narrow = narrow | F.coalesce((F.col("_t") - a <= F.col("_eps")) & (b - F.col("_t") <= F.col("_eps")), F.lit(False))
    s = s.withColumn("_core", narrow)
    last = F.last(F.when(F.col("_core"), F.col("_t")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(F.when(F.col("_core"), F.col("_t")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    s = s.withColumn("_joins", F.coalesce(F.col("_t") - last <= F.col("_eps"), F.lit(False))).withColumn("_leads", ~F.col("_core") & F.coalesce(ahead - F.col("_t") <= F.col("_eps"), F.lit(False)))
    # A session begins at a point that joins nothing before it, unless the point before it already leads to the same core.
    prior = F.coalesce(F.lag(F.col("_leads") & ~F.col("_joins")).over(order), F.lit(False))
    begins = ~F.col("_joins") & ~(prior & (F.col("_core") | F.col("_leads")))
    return s.withColumn("session", F.sum(begins.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_t", "_eps", "_core", "_joins", "_leads")


def hash_split(key: Column, parts: list[int], seed: str = "split") -> Column:
    """The number of the part (of given weights) a key falls into; the same at any partitioning."""
    h, at = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") % sum(parts), 0
    out = F.lit(len(parts) - 1)
    for k in range(len(parts) - 1, -1, -1):
        out = F.when(h < sum(parts[: k + 1]), k).otherwise(out)
    return out


# Queries ----------------------------------------------------------------------------------------------------------


def pred_succ(spark, d):
    m = classified(spark, d).where(F.col("cls") == ADDR)
    return neighbours(m, "sender", "other").select("id", "prev_id", "next_id")


def inter_event(spark, d):
    m = classified(spark, d)
    w = Window.partitionBy("sender").orderBy("ts", "id")
    return m.withColumn("delta", (epoch(F.col("ts")) - F.lag(epoch(F.col("ts"))).over(w)) / 1e6).where("delta IS NOT NULL").select("id", F.round("delta", 3).alias("delta"))


def chain_sizes(spark, d):
    r = roots(links(social.messages(spark, d)))
    return r.groupBy("root").agg(F.count("*").alias("size"), F.max("depth").cast("int").alias("depth")).where("size > 2")


def chain_deltas(spark, d):
    m, r = social.messages(spark, d), roots(links(social.messages(spark, d)))
    w = Window.partitionBy("root").orderBy("ts", "id")
    x = r.join(m.select(F.col("id").alias("node"), F.col("id"), "ts"), "node").withColumn("delta", (epoch(F.col("ts")) - F.lag(epoch(F.col("ts"))).over(w)) / 1e6)
    return x.where("delta IS NOT NULL").select("root", F.col("node").alias("id"), F.round("delta", 3).alias("delta"))


def delta_log_histo(spark, d):
    x = inter_event(spark, d).where("delta > 0")
    return x.groupBy(F.floor(F.log10("delta")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("delta"), 3).alias("mean"))


def slices_fixed(spark, d):
    return fixed_slices(classified(spark, d), 10, "sender").groupBy("sender", "slice").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def slices_weekly(spark, d):
    return weekly(classified(spark, d)).groupBy(F.date_format("week", "yyyy-MM-dd").alias("week"), "topic").agg(F.count("*").alias("n"))


def time_bins(spark, d):
    m = classified(spark, d)
    return m.groupBy("sender", time_bin(F.col("ts"), "2024-01-01", 6 * 3600).alias("bin")).agg(F.count("*").alias("n"))


def leading_backdated(spark, d):
    """Events after a user's first one that is not back-dated."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = social.table(spark, d, "events").withColumn("ok", ~((F.hour("ts") % 6) == 0))
    return e.withColumn("seen", F.max("ok").over(w)).where("seen").select("event_id")


def epoch_minutes(spark, d):
    return social.table(spark, d, "events").select("event_id", F.floor((epoch(F.col("ts")) / 1e6 - 1262304000) / 60).cast("long").alias("minutes"))


def dbscan1d(spark, d):
    s = dbscan_1d(classified(spark, d), 0.5, 3, "sender")
    return s.groupBy("sender", "session").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def sequence_lengths(spark, d):
    m = classified(spark, d).where(F.col("cls") == ADDR).groupBy("sender", "other").agg(F.count("*").alias("length"))
    return m.groupBy("length").agg(F.count("*").alias("n"))


def train_test_split(spark, d):
    return social.users(spark, d).select("id", hash_split(F.col("id"), [1, 8, 1]).alias("part"))


def systematic_sample(spark, d):
    """Every 50th purchase in the order of its value."""
    return ranked(social.table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "value"), "value", "event_id").where("(rank + 1) % 50 = 0").select("event_id", "value")


def hash_sample(spark, d):
    e = social.explicit_edges(spark, d).withColumn("h", F.md5(F.concat_ws(",", "src", "dst")))
    return e.orderBy("h").limit(100).select("src", "dst")


def running_total(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return social.table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("total"))


def dev_folds(spark, d):
    """Ten runs of users in order of id, of equal size but for the last, which has the remainder too."""
    u = social.users(spark, d).select("id")
    size = u.agg(F.greatest(F.floor(F.count("*") / 10), F.lit(1)).alias("size"))  # one row
    return ranked(u, "id").crossJoin(F.broadcast(size)).select("id", (F.least(F.floor(F.col("rank") / F.col("size")), F.lit(9)) + 1).cast("int").alias("fold"))


LK = "lk AS (SELECT c.id AS child, p.id AS parent FROM messages c LEFT JOIN messages p ON p.id = c.parent_id WHERE c.parent_id IS NOT NULL AND (p.ts IS NULL OR c.ts >= p.ts))"
RT = "rt(node, root, depth) AS (SELECT DISTINCT x, x, 0 FROM (SELECT parent AS x FROM lk WHERE parent IS NOT NULL UNION SELECT child FROM lk WHERE parent IS NULL) WHERE x NOT IN (SELECT child FROM lk WHERE parent IS NOT NULL) UNION ALL SELECT lk.child, rt.root, rt.depth + 1 FROM rt JOIN lk ON lk.parent = rt.node)"
QUERIES = {
    "pred_succ": (pred_succ, sql("SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM classified WHERE cls = 'ADDR' WINDOW w AS (PARTITION BY sender, other ORDER BY ts, id)")),
    "inter_event": (inter_event, sql("SELECT id, round(delta, 3) AS delta FROM (SELECT id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sender ORDER BY ts, id)) / 1e6 AS delta FROM messages) WHERE delta IS NOT NULL")),
    "chain_sizes": (chain_sizes, sql("SELECT root, count(*) AS size, max(depth) AS depth FROM rt GROUP BY 1 HAVING count(*) > 2", LK, RT, recursive=True)),
    "chain_deltas": (chain_deltas, sql("SELECT root, id, round(delta, 3) AS delta FROM (SELECT root, id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY root ORDER BY ts, id)) / 1e6 AS delta FROM rt JOIN messages ON id = node) WHERE delta IS NOT NULL", LK, RT, recursive=True)),
    "delta_log_histo": (delta_log_histo, sql("SELECT CAST(floor(log10(delta)) AS BIGINT) AS bin, count(*) AS n, round(avg(delta), 3) AS mean FROM (SELECT round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sender ORDER BY ts, id)) / 1e6, 3) AS delta FROM messages) WHERE delta > 0 GROUP BY 1")),
    "slices_fixed": (slices_fixed, sql("SELECT sender, slice, count(*) AS n, min(id) AS first FROM (SELECT sender, id, (row_number() OVER (PARTITION BY sender ORDER BY ts, id) - 1) // 10 AS slice FROM messages) GROUP BY ALL")),
    "slices_weekly": (slices_weekly, sql("SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05'), '%Y-%m-%d') AS week, topic, count(*) AS n FROM messages GROUP BY ALL")),
    "time_bins": (time_bins, sql("SELECT sender, CAST(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 21600000000) AS BIGINT) AS bin, count(*) AS n FROM messages GROUP BY ALL")),
    "leading_backdated": (leading_backdated, "SELECT event_id FROM (SELECT event_id, bool_or(hour(ts) % 6 <> 0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events) WHERE seen"),
    "epoch_minutes": (epoch_minutes, "SELECT event_id, CAST(floor((epoch_us(ts) / 1e6 - 1262304000) / 60) AS BIGINT) AS minutes FROM events"),
    "dbscan1d": (dbscan1d, sql("""SELECT sender, session, count(*) AS n, min(id) AS first FROM (SELECT *, CAST(sum(CASE WHEN NOT joins AND NOT (prior AND (core OR leads)) THEN 1 ELSE 0 END) OVER (PARTITION BY sender ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
      FROM (SELECT *, coalesce(lag(leads AND NOT joins) OVER (PARTITION BY sender ORDER BY t, id), false) AS prior FROM (SELECT *, coalesce(t - last_value(CASE WHEN core THEN t END IGNORE NULLS) OVER (PARTITION BY sender ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= eps, false) AS joins,
        NOT core AND coalesce(first_value(CASE WHEN core THEN t END IGNORE NULLS) OVER (PARTITION BY sender ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - t <= eps, false) AS leads
        FROM (SELECT a.sender, a.id, a.t, a.eps, (SELECT count(*) FROM p b WHERE b.sender = a.sender AND abs(b.t - a.t) <= a.eps) >= 3 AS core FROM p a)))) GROUP BY ALL""",
      "p AS (SELECT sender, id, epoch_us(ts) AS t, (max(epoch_us(ts)) OVER (PARTITION BY sender) - min(epoch_us(ts)) OVER (PARTITION BY sender)) / greatest(count(*) OVER (PARTITION BY sender) - 1, 1) * 0.5 AS eps FROM messages)")),
    "sequence_lengths": (sequence_lengths, sql("SELECT length, count(*) AS n FROM (SELECT count(*) AS length FROM classified WHERE cls = 'ADDR' GROUP BY sender, other) GROUP BY 1")),
    "train_test_split": (train_test_split, sql("SELECT id, CAST(CASE WHEN h < 1 THEN 0 WHEN h < 9 THEN 1 ELSE 2 END AS INTEGER) AS part FROM (SELECT id, CAST(('0x' || substr(md5('split' || id), 1, 8)) AS BIGINT) % 10 AS h FROM users)")),
    "systematic_sample": (systematic_sample, "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY value, event_id) AS r FROM events WHERE event_type = 'purchase') WHERE r % 50 = 0"),
    "hash_sample": (hash_sample, sql("SELECT src, dst FROM explicit_edges ORDER BY md5(src || ',' || dst) LIMIT 100")),
    "running_total": (running_total, "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders"),
    "dev_folds": (dev_folds, sql("SELECT id, CAST(least((row_number() OVER (ORDER BY id) - 1) // greatest((SELECT count(*) FROM users) // 10, 1), 9) + 1 AS INTEGER) AS fold FROM users")),
}
