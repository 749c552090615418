"""Vector functions as queries: projection and filtering of topic distributions, series, permutations, densities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators.messages import NON_ADDR, classified
from quern.operators.neighbourhood import CT
from quern.operators.theta import TH, WT, theta, weekly_theta
from quern.operators.windows import inter_event
from quern.sources import social
from quern.sources.social import TOPICS, sql


def global_theta(spark, d):
    m = classified(spark, d).where(F.col("cls") == NON_ADDR).withColumn("all", F.lit(1))
    return F.broadcast(theta(m, "all").select(F.col("theta").alias("prior")))  # one row


def noise_projection(spark, d):
    """Topics that hold less than 19.9 % of all messages are noise: the users' distributions over the others."""
    t = theta(classified(spark, d).where(F.col("cls") == NON_ADDR), "sender").crossJoin(global_theta(spark, d))
    return t.select(F.col("sender").alias("user"), F.explode(V.select_topics("theta", "prior", 0.199)).alias("x")).select("user", "x.topic", F.round("x.p", 6).alias("p"))


def prior_filter(spark, d):
    """Distributions of users on single days that differ from the uniform prior, by number of messages."""
    m = classified(spark, d).where(F.col("cls") == NON_ADDR)
    t = theta(m.withColumn("day", F.to_date("ts")), "sender", "day").withColumn("u", F.array(*[F.lit(1.0 / TOPICS)] * TOPICS))
    return t.withColumn("differs", V.differs("theta", "u")).groupBy("day", "differs").agg(F.count("*").alias("n")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "differs", "n")


def series(spark, d):
    """user, and the shares of topics of its weeks in order, not smoothed."""
    m = classified(spark, d).where(F.col("cls") == NON_ADDR).groupBy(F.col("sender").alias("user"), F.to_date(F.date_trunc("week", "ts")).alias("week"))
    t = m.agg(F.array(*[F.count_if(F.col("topic") == k) for k in range(TOPICS)]).alias("n")).select("user", "week", V.normalize(F.col("n").cast("array<double>")).alias("p"))
    return t.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("week", "p"))), lambda x: x["p"]).alias("s"))


def live_topics(spark, d):
    """Topics that a user ever has: the others are constant and leave a causality test."""
    return series(spark, d).select("user", F.explode(V.live_components("s")).alias("topic"))


def centred_series(spark, d):
    return series(spark, d).select("user", F.posexplode(V.centred("s")).alias("step", "v")).select("user", "step", F.posexplode("v").alias("topic", "p")).withColumn("p", F.round(F.col("p") + 0.0, 6))


def joined_series(spark, d):
    """Each user's series beside that of the user after it, turned into one row a component: its first and last value."""
    s = series(spark, d)
    t = s.select((F.col("user") - 1).alias("user"), F.col("s").alias("t"))
    both = s.join(t, "user").where(F.size("s") == F.size("t")).select("user", F.posexplode(V.transpose(V.side_by_side("s", "t"))).alias("component", "v"))
    return both.select("user", "component", F.size("v").alias("steps"), F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


def present_steps(spark, d):
    """Days on which a user is present, as indexes into the month."""
    per = classified(spark, d).groupBy("sender").agg(F.collect_set(F.dayofmonth("ts")).alias("days"))
    v = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.when(F.array_contains("days", i), i))
    return per.select("sender", F.explode(V.present(v)).alias("step"))


def permutations(spark, d):
    """The permutation of four steps that each user's id stands for."""
    return social.users(spark, d).select("id", F.array_join(F.transform(V.kth_permutation(F.col("id") % 24, 4), lambda x: x.cast("string")), ",").alias("permutation"))


def density_curves(spark, d):
    """Curves to plot: per class the Gaussian of log10 gaps at 21 places, the same as a log-normal density, and where it passes 0.1."""
    x = inter_event(spark, d).where("delta > 0").join(classified(spark, d).select("id", "cls"), "id").withColumn("l", F.log10("delta"))
    s = x.groupBy("cls").agg(F.avg("l").alias("m"), F.stddev_samp("l").alias("sd"))
    p = s.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / 4.0)))
    b = V.level_bounds(F.col("m"), F.col("sd"), F.lit(0.1))
    return p.select("cls", "x", F.round(V.gaussian(F.col("x"), F.col("m"), F.col("sd")), 6).alias("density"), F.round(V.log_normal(F.col("x") + 1, F.col("m"), F.col("sd")), 6).alias("log_density"), F.round(b[0], 6).alias("low"), F.round(b[1], 6).alias("high"))


def model_sizes(spark, d):
    """Parameters and BIC of models of 1 to 5 states, with users and pairs counted from the messages."""
    m = classified(spark, d)
    n = m.agg(F.countDistinct("sender", "other").alias("pairs"), F.count("*").alias("n"), F.countDistinct("event_type").alias("words")).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(5))))
    p = n.select("s", "n", V.hmm_parameters(F.col("s")).cast("long").alias("hmm"), V.art_parameters(F.col("pairs"), F.lit(TOPICS), F.col("words")).alias("art"), V.social_parameters(F.col("pairs"), F.col("s"), F.lit(TOPICS), F.col("words")).alias("social"))
    return p.select("s", "hmm", "art", "social", F.round(V.bic(F.lit(-1000.0), F.col("hmm"), F.col("n")), 6).alias("bic"), F.round(V.perplexity(F.lit(-1000.0), F.col("n")), 6).alias("perplexity"))


def log_ratios(spark, d):
    """Additive log ratios of the raw shares of a user's topics, zeros replaced."""
    m = classified(spark, d).where(F.col("cls") == NON_ADDR).groupBy(F.col("sender").alias("user")).agg(F.array(*[F.count_if((F.col("topic") == k) & (F.col("k") < 20)) for k in range(TOPICS)]).alias("n"))
    v = V.normalize(F.col("n").cast("array<double>"))
    return m.where(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x) > 0).select("user", F.posexplode(V.additive_log_ratio(v)).alias("topic", "x")).withColumn("x", F.round("x", 6))


def vector_measures(spark, d):
    """Soft threshold, log-sum-exp, transition distance and cumulated shares of a user's topics against the global ones."""
    t = theta(classified(spark, d).where(F.col("cls") == NON_ADDR), "sender").crossJoin(global_theta(spark, d))
    two = lambda a, b: F.array(F.col(a), F.col(b))
    return t.select(F.col("sender").alias("user"), F.round(V.total(F.transform("theta", lambda x: V.soft_threshold(x - 0.2, 0.05))), 6).alias("soft"), F.round(V.log_sum_exp("theta"), 6).alias("lse"),
        F.round(V.transition_distance(two("theta", "prior"), two("prior", "prior")), 6).alias("transition"), F.round(V.cumulative("theta")[2], 6).alias("upto"), V.argmax(F.transform("theta", lambda x: F.round(x, 6))).alias("top"))


def sorted_changes(spark, d):
    """Differences of a user's leading share from week to week, as an ordered window."""
    t = weekly_theta(spark, d).select("user", "week", F.round(F.array_max("theta"), 6).alias("p"))
    w = Window.partitionBy("user").orderBy("week")
    return t.select("user", F.date_format("week", "yyyy-MM-dd").alias("week"), F.round(F.col("p") - F.lag("p").over(w), 6).alias("change")).where("change IS NOT NULL")


GT = "gt AS (SELECT topic, (count(*) + 0.5) / ((SELECT count(*) FROM classified WHERE cls = 'NON_ADDR') + 2.5) AS q FROM classified WHERE cls = 'NON_ADDR' GROUP BY 1)"
SE = """sw AS (SELECT sender AS u, date_trunc('week', ts) AS week, count(*) AS n FROM classified WHERE cls = 'NON_ADDR' GROUP BY ALL),
st AS (SELECT g.u, g.week, t.k AS topic, coalesce(w.n, 0) / g.n AS p, dense_rank() OVER (PARTITION BY g.u ORDER BY g.week) - 1 AS step FROM sw g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN (SELECT sender, date_trunc('week', ts) AS week, topic, count(*) AS n FROM classified WHERE cls = 'NON_ADDR' GROUP BY ALL) w ON w.sender = g.u AND w.week = g.week AND w.topic = t.k)"""
QUERIES = {
    "noise_projection": (noise_projection, sql("SELECT u AS \"user\", CAST(topic AS INTEGER) AS topic, round(p / sum(p) OVER (PARTITION BY u), 6) AS p FROM ct WHERE topic IN (SELECT topic FROM gt WHERE q >= 0.199)", CT, GT)),
    "prior_filter": (prior_filter, sql("SELECT strftime(day, '%Y-%m-%d') AS day, hi <> lo AS differs, count(*) AS n FROM (SELECT sender, day, max(c) AS hi, min(c) AS lo FROM (SELECT g.sender, g.day, t.k, count(m.id) AS c FROM (SELECT DISTINCT sender, CAST(ts AS DATE) AS day FROM classified WHERE cls = 'NON_ADDR') g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN (SELECT * FROM classified WHERE cls = 'NON_ADDR') m ON m.sender = g.sender AND CAST(m.ts AS DATE) = g.day AND m.topic = t.k GROUP BY ALL) GROUP BY ALL) GROUP BY ALL")),
    "live_topics": (live_topics, sql("SELECT DISTINCT sender AS \"user\", CAST(topic AS INTEGER) AS topic FROM classified WHERE cls = 'NON_ADDR'")),
    "centred_series": (centred_series, sql("SELECT u AS \"user\", CAST(step AS INTEGER) AS step, CAST(topic AS INTEGER) AS topic, round(p - avg(p) OVER (PARTITION BY u, topic) + 0.0, 6) AS p FROM st", SE)),
    "joined_series": (joined_series, sql("""SELECT a.u AS "user", CAST(x.topic AS INTEGER) AS component, CAST(a.n AS INTEGER) AS steps, round(x.f, 6) AS first, round(x.l, 6) AS last FROM (SELECT u, count(DISTINCT week) AS n FROM st GROUP BY 1) a JOIN (SELECT u, count(DISTINCT week) AS n FROM st GROUP BY 1) b ON b.u = a.u + 1 AND b.n = a.n
      JOIN (SELECT u, topic, arg_min(p, step) AS f, arg_max(p, step) AS l FROM st GROUP BY ALL UNION ALL SELECT u - 1, topic + 5, arg_min(p, step), arg_max(p, step) FROM st GROUP BY ALL) x ON x.u = a.u""", SE)),
    "present_steps": (present_steps, sql("SELECT DISTINCT sender, CAST(day(ts) - 1 AS INTEGER) AS step FROM messages WHERE day(ts) <= 30")),
    "permutations": (permutations, sql("SELECT id, p AS permutation FROM users JOIN (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS r, a || ',' || b || ',' || c || ',' || (6 - a - b - c) AS p FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b), (SELECT unnest(range(4)) AS c) WHERE a <> b AND b <> c AND a <> c) ON r = id % 24")),
    "density_curves": (density_curves, sql("""SELECT cls, x, round(exp(-(((x - m) / sd) ** 2) / 2) / (sd * sqrt(2 * pi())), 6) AS density, round(exp(-(((ln(x + 1) - m) / sd) ** 2) / 2) / (sd * sqrt(2 * pi())) / (x + 1), 6) AS log_density, CASE WHEN 0.1 * sd * sqrt(2 * pi()) <= 1 THEN round(m - sd * sqrt(-2 * ln(0.1 * sd * sqrt(2 * pi()))), 6) END AS low,
      CASE WHEN 0.1 * sd * sqrt(2 * pi()) <= 1 THEN round(m + sd * sqrt(-2 * ln(0.1 * sd * sqrt(2 * pi()))), 6) END AS high FROM (SELECT cls, avg(log10(delta)) AS m, stddev_samp(log10(delta)) AS sd FROM (SELECT cls, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sender ORDER BY ts, id)) / 1e6, 3) AS delta FROM classified) WHERE delta > 0 GROUP BY 1), (SELECT unnest(range(21)) / 4.0::DOUBLE AS x)""")),
    "model_sizes": (model_sizes, sql("SELECT CAST(s AS INTEGER) AS s, s * s + 2 * s - 1 AS hmm, pairs * 4 + 5 * (words - 1) AS art, s * pairs * (3 + s) + 5 * (words - 1) AS social, round(2000 + (s * s + 2 * s - 1) * ln(n), 6) AS bic, round(exp(1000 / n), 6) AS perplexity FROM (SELECT count(DISTINCT (sender, other)) AS pairs, count(*) AS n, count(DISTINCT event_type) AS words FROM messages), (SELECT unnest(range(1, 6)) AS s)")),
    "log_ratios": (log_ratios, sql("""SELECT u AS "user", CAST(topic AS INTEGER) AS topic, round(ln(f / l), 6) AS x FROM (SELECT u, topic, f, max(CASE WHEN topic = 4 THEN f END) OVER (PARTITION BY u) AS l FROM (SELECT u, topic, CASE WHEN c = 0 THEN r ELSE c / n * (1 - z * r) END AS f FROM (SELECT *, 1e-7 * (z + 1) * (5 - z) / 25 AS r
      FROM (SELECT *, sum(c) OVER (PARTITION BY u) AS n, count(*) FILTER (c = 0) OVER (PARTITION BY u) AS z FROM (SELECT g.u, t.k AS topic, count(m.id) AS c FROM (SELECT DISTINCT sender AS u FROM classified WHERE cls = 'NON_ADDR') g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN (SELECT * FROM classified WHERE cls = 'NON_ADDR' AND k < 20) m ON m.sender = g.u AND m.topic = t.k GROUP BY ALL)) WHERE n > 0))) WHERE topic < 4""")),
    "vector_measures": (vector_measures, sql("""SELECT u AS "user", round(sum(CASE WHEN p - 0.2 > 0.05 THEN p - 0.25 WHEN p - 0.2 < -0.05 THEN p - 0.15 ELSE 0 END), 6) AS soft, round(ln(sum(exp(p))), 6) AS lse, round(sqrt(greatest(sum(0.5 * (p * ln(p) + q * ln(q)) - (p + q) / 2 * ln((p + q) / 2)) / ln(2), 0)) / 2, 6) AS transition,
      round(sum(p) FILTER (ct.topic <= 2), 6) AS upto, CAST(arg_min(ct.topic, round(-p, 6) * 1000000 * 10 + ct.topic) AS INTEGER) AS top FROM ct JOIN gt ON gt.topic = ct.topic GROUP BY 1""", CT, GT)),
    "sorted_changes": (sorted_changes, sql("SELECT u AS \"user\", strftime(week, '%Y-%m-%d') AS week, round(p - q, 6) AS change FROM (SELECT u, week, p, lag(p) OVER (PARTITION BY u ORDER BY week) AS q FROM (SELECT u, week, round(max(p), 6) AS p FROM th GROUP BY ALL)) WHERE q IS NOT NULL", WT, TH)),
}
