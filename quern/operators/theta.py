"""Counts and topic distributions per user, pair and time slice; their change and similarity over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators.messages import ADDR, NON_ADDR, SHARED, classified, in_slice
from quern.operators.tables import cut, ranked
from quern.sources import social
from quern.sources.social import TOPICS, sql

ALPHA = 0.5
CENTERS, LENGTHS = ("2024-01-22", "2024-01-15", "2024-01-08"), (2, 5, 7)


def intervals(spark: SparkSession, centers: tuple[str, ...] = CENTERS, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Slices before (sign -1) and after (+1) each centre date: center, len, sign, start, end. They overlap."""
    rows = ", ".join(f"('{c}', {n}, {s})" for c in centers for n in lengths for s in (-1, 1))
    d = spark.sql(f"SELECT * FROM VALUES {rows} AS t(center, len, sign)")
    at, days = F.to_timestamp_ntz("center"), F.make_dt_interval(F.col("len"))
    return d.select("center", "len", "sign", F.when(F.col("sign") < 0, at - days).otherwise(at).alias("start"), F.when(F.col("sign") < 0, at).otherwise(at + days).alias("end"))


def sliced(m: DataFrame, slices: DataFrame) -> DataFrame:
    """Each message once per slice it falls into. The slice table is a parameter of the analysis: a few rows, broadcast."""
    return m.join(F.broadcast(slices), in_slice(F.col("ts"), F.col("start"), F.col("end")))


def weekly(m: DataFrame) -> DataFrame:
    """Consecutive weeks from Mondays: a bucket, not a join."""
    return m.withColumn("week", F.window(F.col("ts").cast("timestamp"), "7 days", startTime="4 days").start.cast("timestamp_ntz"))


def topic_counts(m: DataFrame, *keys: str) -> DataFrame:
    """keys, counts (array over topics): one partial aggregation per topic, no pivot."""
    return m.groupBy(*keys).agg(F.array(*[F.count_if(F.col("topic") == k) for k in range(TOPICS)]).alias("counts"))


def theta(m: DataFrame, *keys: str, alpha: float = ALPHA) -> DataFrame:
    return topic_counts(m, *keys).select(*keys, V.smooth("counts", alpha).alias("theta"))


def weekly_theta(spark: SparkSession, d: str) -> DataFrame:
    return theta(weekly(classified(spark, d).where(F.col("cls") == NON_ADDR)), "sender", "week").withColumnRenamed("sender", "user")


def change_series(series: DataFrame) -> DataFrame:
    """user, week, theta, direction, magnitude against the week before (missing: direction null, magnitude 1)."""
    w = Window.partitionBy("user").orderBy("week")
    prev, before = F.lag("theta").over(w), F.lag("week").over(w)
    s = series.withColumn("_p", F.when(before == F.col("week") - F.expr("INTERVAL 7 DAYS"), prev))
    return s.select("user", "week", "theta", V.change_direction("_p", "theta").alias("direction"), V.change_magnitude("_p", "theta").alias("magnitude"))


def lagged_similarity(edges: DataFrame, series: DataFrame, steps: int, least_active: int = 0, use: str = "theta") -> DataFrame:
    """src, dst, similarity, active: how well src's vector one step earlier meets the direction of dst's change.

    ``steps`` is the number of weeks T; the sum is divided by T - 1 whatever is missing. Below ``least_active`` active
    steps the similarity is null.
    """
    c = cut(change_series(series))  # both sides of the join read it
    src = c.select(F.col("user").alias("src"), (F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("week"), F.col(use).alias("_s"))
    dst = c.select(F.col("user").alias("dst"), "week", F.col("direction").alias("_d"), "magnitude")
    at = edges.join(dst, "dst").join(src, ["src", "week"]).where("_s IS NOT NULL AND _d IS NOT NULL")
    gain = F.col("magnitude") * F.greatest(F.lit(0.0), V.LN2 - V.jsd_e("_s", "_d"))
    got = at.groupBy("src", "dst").agg((F.sum(gain) / (V.LN2 * (steps - 1))).alias("similarity"), F.count("*").alias("active"))
    out = edges.join(got, ["src", "dst"], "left").select("src", "dst", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("active", F.lit(0)).alias("active"))
    return out.withColumn("similarity", F.when(F.col("active") >= least_active, F.col("similarity")))


def exploded(df: DataFrame, keys: list[str], col: str = "theta") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("topic", "p")).withColumn("p", F.round("p", 6))


def complement_edges(vertices: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """n pairs without an edge, in hash order. Sampled sources and targets are paired by rank: V x V is never formed.

    Draws ordered pairs by hashing a counter into the vertex ranks, drops loops, doubles and edges, keeps the first n. The counter
    goes to 4 n and then on, twice as far each time, until there are n; a graph with fewer than n free pairs is an error.
    """
    ranks = cut(ranked(vertices.select("id"), "id").withColumnRenamed("rank", "r"))
    size = ranks.count()
    loops = edges.where("src <> dst").distinct().count()
    if size * (size - 1) - loops < n:
        raise ValueError(f"there are fewer than {n} pairs without an edge")
    spark, draws = vertices.sparkSession, 4 * n
    part = lambda letter: (F.conv(F.substring(F.md5(F.concat(F.lit(letter), "id")), 1, 12), 16, 10).cast("long") % F.lit(size))
    while True:
        draw = spark.range(draws).select("id", part("a").alias("ra"), part("b").alias("rb")).where("ra <> rb")
        p = draw.join(ranks.select(F.col("id").alias("src"), F.col("r").alias("ra")), "ra").join(ranks.select(F.col("id").alias("dst"), F.col("r").alias("rb")), "rb")
        found = cut(p.groupBy("src", "dst").agg(F.min("id").alias("k")).join(edges, ["src", "dst"], "left_anti").orderBy("k").limit(n).select("src", "dst"))
        if found.count() == n:
            return found
        draws *= 2


# Queries ----------------------------------------------------------------------------------------------------------


def interval_counts(spark, d):
    m = sliced(classified(spark, d), intervals(spark))
    return m.groupBy("center", "len", "sign", "sender").agg(F.count_if(F.col("cls") == NON_ADDR).alias("non_addr"), F.count_if(F.col("cls") == ADDR).alias("addr"), F.count_if(F.col("cls") == SHARED).alias("shared"))


def got_shared(spark, d):
    m = sliced(classified(spark, d).where(F.col("cls") == SHARED), intervals(spark))
    return m.groupBy("center", "len", "sign", F.col("other").alias("user")).agg(F.count("*").alias("n"))


def exposers(spark, d):
    m = classified(spark, d).where(F.col("cls") == ADDR)
    return m.groupBy("other").agg(F.countDistinct("sender").alias("n"), F.min("sender").alias("first"))


def theta_pair(spark, d):
    return exploded(theta(classified(spark, d).where(F.col("cls") == ADDR), "sender", "other"), ["sender", "other"])


def theta_grouping_sets(spark, d):
    m = classified(spark, d).where(F.col("cls") == ADDR)
    g = m.groupingSets([["sender", "other"], ["sender"], ["other"], []], "sender", "other").agg(F.grouping_id().alias("gid"), F.array(*[F.count_if(F.col("topic") == k) for k in range(TOPICS)]).alias("counts"))
    return exploded(g.withColumn("theta", V.smooth("counts", ALPHA)), ["sender", "other"])


def phi(spark, d):
    """p(event type | topic) with a symmetric prior."""
    c = classified(spark, d).groupBy("topic", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("topic")
    return c.select("topic", "event_type", F.round((F.col("n") + 0.01) / (F.sum("n").over(w) + 0.01 * F.count("*").over(w)), 6).alias("phi"))


def mean_theta(spark, d):
    t = weekly_theta(spark, d).select("user", F.posexplode("theta").alias("topic", "p"))
    return t.groupBy("user", "topic").agg(F.round(F.avg("p"), 6).alias("p"))


def entropy_by_week(spark, d):
    t = weekly_theta(spark, d).withColumn("h", V.entropy("theta"))
    return t.groupBy("week").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("entropy")).select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n", "entropy")


def change(spark, d):
    c = change_series(weekly_theta(spark, d))
    return c.select("user", F.date_format("week", "yyyy-MM-dd").alias("week"), F.round("magnitude", 6).alias("magnitude"), F.posexplode_outer(F.transform("direction", lambda x: F.round(x, 6))).alias("topic", "p"))


def similarity_level(spark, d):
    return lagged_similarity(social.explicit_edges(spark, d), weekly_theta(spark, d), 5).select("src", "dst", F.round("similarity", 6).alias("similarity"), "active")


def similarity_edge(spark, d):
    return lagged_similarity(social.explicit_edges(spark, d), weekly_theta(spark, d), 5, use="direction").select("src", "dst", F.round("similarity", 6).alias("similarity"), "active")


def calibrated(spark, d):
    """Edges whose similarity reaches mean + 3 sd of that of pairs without an edge."""
    e, t = social.explicit_edges(spark, d), weekly_theta(spark, d)
    fake = complement_edges(social.users(spark, d).select("id"), e, 200)
    base = lagged_similarity(fake, t, 5).agg((F.avg("similarity") + 3 * F.coalesce(F.stddev_samp("similarity"), F.lit(0.0))).alias("level"))
    s = lagged_similarity(e, t, 5).crossJoin(F.broadcast(base))
    return s.where("similarity >= level").select("src", "dst", F.round("similarity", 6).alias("similarity"))


def top_edges(spark, d):
    s = similarity_level(spark, d)
    return s.orderBy(F.desc("similarity"), "src", "dst").limit(20).select("src", "dst", "similarity")


def complement(spark, d):
    return complement_edges(social.users(spark, d).select("id"), social.explicit_edges(spark, d), 200)


def activity_rate(spark, d):
    """Share of centre dates at which a user has messages both in the week before and the week after."""
    m = sliced(classified(spark, d).where(F.col("cls") == NON_ADDR), intervals(spark, lengths=(7,)))
    both = m.groupBy("sender", "center").agg(F.countDistinct("sign").alias("k"))
    per = both.groupBy("sender").agg((F.count_if(F.col("k") == 2) / float(len(CENTERS))).alias("rate"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg("rate"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("rate"), F.lit(0.0)), 6).alias("sd"), F.count_if(F.col("rate") > 0).alias("active"))


def missing_rate(spark, d):
    t = weekly_theta(spark, d).groupBy("user").agg((1 - F.count("*") / 5.0).alias("r"))
    return t.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("r"), F.lit(0.0)), 6).alias("sd"))


def similarity_by_influencer(spark, d):
    s = lagged_similarity(social.explicit_edges(spark, d), weekly_theta(spark, d), 5)
    return s.groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("mean"), F.round(F.max("similarity"), 6).alias("most"))


def similarity_histogram(spark, d):
    """Bins L < x <= U of width 0.05 with the mean number of active steps."""
    s = lagged_similarity(social.explicit_edges(spark, d), weekly_theta(spark, d), 5).where("similarity > 0")
    return s.groupBy(F.ceil(F.round("similarity", 6) * 20).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("active"), 6).alias("active"))


def similarity_bh(spark, d):
    """Benjamini-Hochberg per influencee on p = 1 - similarity: the largest i with p_(i) <= i / n * alpha."""
    s = similarity_level(spark, d).withColumn("p", F.round(1 - F.col("similarity") * 4, 6))
    w = Window.partitionBy("dst").orderBy("p", "src")
    r = s.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("dst")))
    k = F.max(F.when(F.col("p") <= F.col("i") / F.col("n") * 0.9, F.col("i"))).over(Window.partitionBy("dst"))
    return r.withColumn("k", k).where("i <= k").select("src", "dst", "p")


def longest_runs(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """src, dst, start, length: per edge the longest run of steps (user, i) where both are present; a run may take one more step at
    which dst alone is. The first of equals; edges without a common step are left out.

    Present steps are few rows of each edge; islands come from a row number, the step after an island from a join.
    """
    dst = edges.join(steps.select(F.col("user").alias("dst"), "i"), "dst")
    both = dst.join(steps.select(F.col("user").alias("src"), "i"), ["src", "i"], "left_semi")
    r = both.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("src", "dst").orderBy("i")))
    runs = r.groupBy("src", "dst", "g").agg(F.min("i").alias("start"), F.max("i").alias("last"))
    tail = dst.select("src", "dst", (F.col("i") - 1).alias("last"), F.lit(1).alias("more"))
    runs = runs.join(tail, ["src", "dst", "last"], "left").withColumn("length", F.col("last") - F.col("start") + 1 + F.coalesce("more", F.lit(0)))
    best = runs.groupBy("src", "dst").agg(F.max(F.struct("length", -F.col("start"))).alias("b"))
    return best.select("src", "dst", (-F.col("b.col2")).alias("start"), F.col("b.length").cast("long").alias("length"))


def week_steps(spark, d):
    return weekly_theta(spark, d).select("user", (F.datediff("week", F.lit("2024-01-01")) / 7).cast("int").alias("i"))


def longest_run(spark, d):
    """Users of even id are absent in every third week, so that runs end early."""
    t = week_steps(spark, d).where("NOT (user % 2 = 0 AND (i + user) % 3 = 2)")
    return longest_runs(social.explicit_edges(spark, d), t)


def weekly_fill(spark, d):
    """Weekly counts with missing weeks as 0, by a dimension of weeks."""
    t = weekly(classified(spark, d)).groupBy(F.col("sender").alias("user"), "week").agg(F.count("*").alias("n"))
    weeks = spark.range(5).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int") * 7)).alias("week"))
    grid = social.users(spark, d).select(F.col("id").alias("user")).crossJoin(F.broadcast(weeks))  # five rows
    return grid.join(t, ["user", "week"], "left").select("user", F.date_format("week", "yyyy-MM-dd").alias("week"), F.coalesce("n", F.lit(0)).alias("n"))


WT = "wt AS (SELECT sender AS u, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05') AS week, topic, count(*) AS n FROM classified WHERE cls = 'NON_ADDR' GROUP BY ALL)"
TH = "th AS (SELECT g.u, g.week, t.k AS topic, (coalesce(w.n, 0) + 0.5) / (g.n + 2.5) AS p FROM (SELECT u, week, sum(n) AS n FROM wt GROUP BY ALL) g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN wt w ON w.u = g.u AND w.week = g.week AND w.topic = t.k)"
CH = """ch AS (SELECT c.u, c.week, c.topic, c.p, b.p AS b, greatest(c.p - b.p, 0) AS up FROM th c LEFT JOIN th b ON b.u = c.u AND b.topic = c.topic AND b.week = c.week - INTERVAL 7 DAY),
dr AS (SELECT u, week, topic, p, CASE WHEN b IS NULL THEN NULL WHEN sum(up) OVER w = 0 THEN 0.2 ELSE up / sum(up) OVER w END AS dir,
  CASE WHEN b IS NULL THEN 1.0 ELSE coalesce(sum(up) OVER w / nullif(1 - least(min(b) OVER w, 1), 0), 0) END AS mag FROM ch WINDOW w AS (PARTITION BY u, week))"""


def similar(col: str, edges: str = "explicit_edges") -> str:
    return f"""j AS (SELECT e.src, e.dst, y.week, max(y.mag) AS mag, sum(0.5 * (CASE WHEN x.{col} > 0 THEN x.{col} * ln(x.{col}) ELSE 0 END + CASE WHEN y.dir > 0 THEN y.dir * ln(y.dir) ELSE 0 END) -
  CASE WHEN x.{col} + y.dir > 0 THEN (x.{col} + y.dir) / 2 * ln((x.{col} + y.dir) / 2) ELSE 0 END) AS jsd
  FROM {edges} e JOIN dr y ON y.u = e.dst AND y.dir IS NOT NULL JOIN dr x ON x.u = e.src AND x.topic = y.topic AND x.week = y.week - INTERVAL 7 DAY AND x.{col} IS NOT NULL GROUP BY ALL),
s AS (SELECT e.src, e.dst, coalesce(sum(mag * greatest(0, ln(2) - jsd)) / (ln(2) * 4), 0) AS similarity, count(week) AS active FROM {edges} e LEFT JOIN j ON j.src = e.src AND j.dst = e.dst GROUP BY ALL)"""


IV = """iv AS (SELECT c AS center, l AS len, s AS sign, CASE WHEN s < 0 THEN CAST(c AS TIMESTAMP) - to_days(l) ELSE CAST(c AS TIMESTAMP) END AS a, CASE WHEN s < 0 THEN CAST(c AS TIMESTAMP) ELSE CAST(c AS TIMESTAMP) + to_days(l) END AS b
  FROM (SELECT unnest(['2024-01-22', '2024-01-15', '2024-01-08']) AS c), (SELECT unnest([2, 5, 7]) AS l), (SELECT unnest([-1, 1]) AS s))"""
COMPLEMENT = """rk AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM users),
dw AS (SELECT i, CAST(('0x' || substr(md5('a' || i), 1, 12)) AS BIGINT) % (SELECT count(*) FROM users) AS ra, CAST(('0x' || substr(md5('b' || i), 1, 12)) AS BIGINT) % (SELECT count(*) FROM users) AS rb FROM (SELECT unnest(range(800)) AS i)),
fk AS (SELECT a.id AS src, b.id AS dst, min(i) AS k FROM dw JOIN rk a ON a.r = ra JOIN rk b ON b.r = rb WHERE ra <> rb GROUP BY ALL),
fake AS (SELECT src, dst FROM fk WHERE NOT EXISTS (SELECT 1 FROM explicit_edges e WHERE e.src = fk.src AND e.dst = fk.dst) ORDER BY k LIMIT 200)"""


def pair_theta(keys: str, on: str) -> str:
    return f"SELECT {keys}, t.k AS topic, round((coalesce(w.n, 0) + 0.5) / (g.n + 2.5), 6) AS p FROM {on}"


QUERIES = {
    "interval_counts": (interval_counts, sql("SELECT center, CAST(len AS INTEGER) AS len, CAST(sign AS INTEGER) AS sign, sender, count(*) FILTER (cls = 'NON_ADDR') AS non_addr, count(*) FILTER (cls = 'ADDR') AS addr, count(*) FILTER (cls = 'SHARED') AS shared FROM classified JOIN iv ON ts > a AND ts <= b GROUP BY ALL", IV)),
    "got_shared": (got_shared, sql("SELECT center, CAST(len AS INTEGER) AS len, CAST(sign AS INTEGER) AS sign, other AS \"user\", count(*) AS n FROM classified JOIN iv ON ts > a AND ts <= b WHERE cls = 'SHARED' GROUP BY ALL", IV)),
    "exposers": (exposers, sql("SELECT other, count(DISTINCT sender) AS n, min(sender) AS first FROM classified WHERE cls = 'ADDR' GROUP BY 1")),
    "theta_pair": (theta_pair, sql("SELECT g.sender, g.other, CAST(t.k AS INTEGER) AS topic, round((coalesce(w.n, 0) + 0.5) / (g.n + 2.5), 6) AS p FROM (SELECT sender, other, count(*) AS n FROM classified WHERE cls = 'ADDR' GROUP BY ALL) g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN (SELECT sender, other, topic, count(*) AS n FROM classified WHERE cls = 'ADDR' GROUP BY ALL) w ON w.sender = g.sender AND w.other = g.other AND w.topic = t.k")),
    "theta_grouping_sets": (theta_grouping_sets, sql("SELECT sender, other, CAST(k AS INTEGER) AS topic, round((c[k + 1] + 0.5) / (n + 2.5), 6) AS p FROM (SELECT sender, other, count(*) AS n, [count(*) FILTER (topic = 0), count(*) FILTER (topic = 1), count(*) FILTER (topic = 2), count(*) FILTER (topic = 3), count(*) FILTER (topic = 4)] AS c FROM classified WHERE cls = 'ADDR' GROUP BY GROUPING SETS ((sender, other), (sender), (other), ())), (SELECT unnest(range(5)) AS k)")),
    "phi": (phi, sql("SELECT topic, event_type, round((n + 0.01) / (sum(n) OVER w + 0.01 * count(*) OVER w), 6) AS phi FROM (SELECT topic, event_type, count(*) AS n FROM classified GROUP BY ALL) WINDOW w AS (PARTITION BY topic)")),
    "mean_theta": (mean_theta, sql("SELECT u AS \"user\", CAST(topic AS INTEGER) AS topic, round(avg(p), 6) AS p FROM th GROUP BY ALL", WT, TH)),
    "entropy_by_week": (entropy_by_week, sql("SELECT strftime(week, '%Y-%m-%d') AS week, count(*) AS n, round(avg(h), 6) AS entropy FROM (SELECT u, week, -sum(p * log2(p)) AS h FROM th GROUP BY ALL) GROUP BY 1", WT, TH)),
    "change": (change, sql("SELECT u AS \"user\", strftime(week, '%Y-%m-%d') AS week, round(mag, 6) AS magnitude, CAST(topic AS INTEGER) AS topic, round(dir, 6) AS p FROM dr WHERE dir IS NOT NULL UNION ALL SELECT DISTINCT u, strftime(week, '%Y-%m-%d'), 1.0, NULL, NULL FROM dr WHERE dir IS NULL", WT, TH, CH)),
    "similarity_level": (similarity_level, sql("SELECT src, dst, round(similarity, 6) AS similarity, active FROM s", WT, TH, CH, similar("p"))),
    "similarity_edge": (similarity_edge, sql("SELECT src, dst, round(similarity, 6) AS similarity, active FROM s", WT, TH, CH, similar("dir"))),
    "complement": (complement, sql("SELECT src, dst FROM fake", COMPLEMENT)),
    "calibrated": (calibrated, sql("SELECT src, dst, round(similarity, 6) AS similarity FROM s WHERE real AND similarity >= (SELECT avg(similarity) + 3 * coalesce(stddev_samp(similarity), 0) FROM s WHERE NOT real)", COMPLEMENT, WT, TH, CH,
      "alledges AS (SELECT src, dst, true AS real FROM explicit_edges UNION ALL SELECT src, dst, false FROM fake)", similar("p", "alledges").replace("s AS (SELECT e.src, e.dst,", "s AS (SELECT e.src, e.dst, e.real,"))),
    "top_edges": (top_edges, sql("SELECT src, dst, round(similarity, 6) AS similarity FROM s ORDER BY round(similarity, 6) DESC, src, dst LIMIT 20", WT, TH, CH, similar("p"))),
    "activity_rate": (activity_rate, sql("SELECT count(*) AS n, round(avg(rate), 6) AS mean, round(coalesce(stddev_samp(rate), 0), 6) AS sd, count(*) FILTER (rate > 0) AS active FROM (SELECT sender, count(*) FILTER (k = 2) / 3.0 AS rate FROM (SELECT sender, center, count(DISTINCT sign) AS k FROM classified JOIN iv ON ts > a AND ts <= b WHERE cls = 'NON_ADDR' AND len = 7 GROUP BY ALL) GROUP BY 1)", IV)),
    "missing_rate": (missing_rate, sql("SELECT round(avg(r), 6) AS mean, round(coalesce(stddev_samp(r), 0), 6) AS sd FROM (SELECT u, 1 - count(DISTINCT week) / 5.0 AS r FROM wt GROUP BY 1)", WT)),
    "similarity_by_influencer": (similarity_by_influencer, sql("SELECT src, count(*) AS n, round(avg(similarity), 6) AS mean, round(max(similarity), 6) AS most FROM s GROUP BY 1", WT, TH, CH, similar("p"))),
    "similarity_histogram": (similarity_histogram, sql("SELECT CAST(ceil(round(similarity, 6) * 20) AS BIGINT) AS bin, count(*) AS n, round(avg(active), 6) AS active FROM s WHERE similarity > 0 GROUP BY 1", WT, TH, CH, similar("p"))),
    "similarity_bh": (similarity_bh, sql("SELECT src, dst, p FROM (SELECT *, max(CASE WHEN p <= i / n * 0.9 THEN i END) OVER (PARTITION BY dst) AS k FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY p, src) AS i, count(*) OVER (PARTITION BY dst) AS n FROM (SELECT src, dst, round(1 - round(similarity, 6) * 4, 6) AS p FROM s))) WHERE i <= k", WT, TH, CH, similar("p"))),
    "longest_run": (longest_run, sql("""SELECT src, dst, CAST(start AS INTEGER) AS start, CAST(length AS BIGINT) AS length FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY length DESC, start) AS k FROM (SELECT r.src, r.dst, r.start, r.last - r.start + 1 + CASE WHEN EXISTS (SELECT 1 FROM ws w WHERE w.u = r.dst AND w.i = r.last + 1) THEN 1 ELSE 0 END AS length
      FROM (SELECT src, dst, g, min(i) AS start, max(i) AS last FROM (SELECT e.src, e.dst, a.i, a.i - row_number() OVER (PARTITION BY e.src, e.dst ORDER BY a.i) AS g FROM explicit_edges e JOIN ws a ON a.u = e.src JOIN ws b ON b.u = e.dst AND b.i = a.i) GROUP BY ALL) r)) WHERE k = 1""",
      WT, "ws AS (SELECT DISTINCT u, date_diff('day', DATE '2024-01-01', CAST(week AS DATE)) // 7 AS i FROM wt WHERE NOT (u % 2 = 0 AND (date_diff('day', DATE '2024-01-01', CAST(week AS DATE)) // 7 + u) % 3 = 2))")),
    "weekly_fill": (weekly_fill, sql("SELECT u.id AS \"user\", strftime(w.week, '%Y-%m-%d') AS week, coalesce(c.n, 0) AS n FROM users u CROSS JOIN (SELECT TIMESTAMP '2024-01-01' + to_days(7 * CAST(k AS INTEGER)) AS week FROM (SELECT unnest(range(5)) AS k)) w LEFT JOIN (SELECT sender, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05') AS week, count(*) AS n FROM classified GROUP BY ALL) c ON c.sender = u.id AND c.week = w.week")),
}
