"""Neighbourhood predictions: membership of candidates, their weights, weighted mean topics, baselines and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators.graphs import reach, two_hop
from quern.operators.messages import ADDR, NON_ADDR, SHARED, classified
from quern.operators.tables import cut
from quern.operators.theta import exploded, theta, weekly_theta
from quern.sources import social
from quern.sources.social import sql

# Indicators: relations (origin, candidate); candidates never include the origin itself.


def explicit_one(explicit: DataFrame, comm: DataFrame) -> DataFrame:
    return explicit.select(F.col("src").alias("origin"), F.col("dst").alias("candidate"))


def explicit_two(explicit: DataFrame, comm: DataFrame) -> DataFrame:
    return two_hop(explicit, explicit).select(F.col("src").alias("origin"), F.col("dst").alias("candidate"))


def comm_one(explicit: DataFrame, comm: DataFrame) -> DataFrame:
    both = comm.select("src", "dst").union(comm.select("dst", "src")).distinct()
    return both.select(F.col("src").alias("origin"), F.col("dst").alias("candidate"))


def comm_two(explicit: DataFrame, comm: DataFrame) -> DataFrame:
    both = comm.select("src", "dst").union(comm.select("dst", "src")).distinct()
    return two_hop(comm.select("src", "dst"), both).select(F.col("src").alias("origin"), F.col("dst").alias("candidate"))


def same_group(members: DataFrame) -> DataFrame:
    """From a table of group, v: all pairs of one group (cliques and communities, whose size the caller knows)."""
    x, y = members.alias("x"), members.alias("y")
    return x.join(y, F.col("x.group") == F.col("y.group")).select(F.col("x.v").alias("origin"), F.col("y.v").alias("candidate")).distinct()


INDICATORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "EXPLICIT_DISTANCE_ONE": explicit_one, "EXPLICIT_DISTANCE_TWO": explicit_two, "COMMUNICATION_DISTANCE_ONE": comm_one, "COMMUNICATION_DISTANCE_TWO": comm_two}
#: These take a membership table (group, v): largest clique, percolated and edge communities.
GROUPED = ("CLIQUE", "COMMUNITIES_PERC", "COMMUNITIES_EDGE")


def memberships(explicit: DataFrame, comm: DataFrame, groups: dict[str, DataFrame] | None = None) -> DataFrame:
    parts = [f(explicit, comm).withColumn("indicator", F.lit(n)) for n, f in INDICATORS.items()]
    parts += [same_group(g).withColumn("indicator", F.lit(n)) for n, g in (groups or {}).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("origin <> candidate")


# Weights: columns over a candidate's features (see ``features``); a missing feature counts as in each default.

L1P = F.log1p


def col(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def similarity(a: str, b: str) -> Column:
    return F.coalesce(1 - V.jsd_2(a, b), F.lit(0.0))


WEIGHTS: dict[str, Callable[[], Column]] = {
    "CONSTANT": lambda: F.lit(1.0),
    "NUM_INCOMING": lambda: col("n_in"), "NUM_INCOMING_1P": lambda: L1P(col("n_in")), "NUM_OUTGOING": lambda: col("n_out"), "NUM_OUTGOING_1P": lambda: L1P(col("n_out")),
    "INCOMING_OUTGOING_LOG_RATIO": lambda: L1P(col("n_in")) / F.when(col("n_out") > 0, L1P(col("n_out"))).otherwise(F.lit(V.LN2)),
    "SHARED_RATIO": lambda: col("got_shared") / F.greatest(F.lit(1.0), col("non_addr")), "NUM_CANDIDATE_GOT_SHARED": lambda: col("got_shared"),
    "NUM_CLIQUE": lambda: col("n_clique"), "NUM_CLIQUE_1P": lambda: L1P(col("n_clique")),
    "NUM_COMMUNITIES_PERC": lambda: col("n_perc"), "INVERSE_NUM_COMMUNITIES_PERC": lambda: 1 / (1 + col("n_perc")), "SHARED_COMMUNITIES_PERC": lambda: col("shared_perc"),
    "NUM_COMMUNITIES_EDGE": lambda: col("n_edge"), "INVERSE_NUM_COMMUNITIES_EDGE": lambda: 1 / (1 + col("n_edge")), "SHARED_COMMUNITIES_EDGE": lambda: col("shared_edge"),
    "SIMILARITY_NODE": lambda: similarity("o_theta", "c_theta"), "SIMILARITY_EDGE": lambda: similarity("o_sender", "c_sender"),
    "SIMILARITY_TO_MAINSTREAM": lambda: similarity("c_theta", "g_theta"), "DISTANCE_TO_MAINSTREAM": lambda: F.coalesce(V.jsd_2("c_theta", "g_theta"), F.lit(0.0)),
    "CANDIDATE_NON_ADDR": lambda: col("non_addr"), "INVERSE_CANDIDATE_NON_ADDR": lambda: 1 / (1 + col("non_addr")),
    "CANDIDATE_ADDR": lambda: col("addr_in") + col("addr_out"), "INVERSE_CANDIDATE_ADDR": lambda: 1 / (1 + col("addr_in") + col("addr_out")),
    "SHARED_NEIGHBORS": lambda: col("shared_neighbors"), "FOCUS_LEVEL": lambda: F.coalesce(V.focus_level("c_theta"), F.lit(0.0)),
    "PAGE_RANK": lambda: col("page_rank"), "BETWEENNESS_CENTRALITY": lambda: col("betweenness"),
    "BIDIRECTIONAL": lambda: F.when(F.col("e_out") & F.col("e_in"), F.when(F.col("t_out") & F.col("t_in"), 4.0).otherwise(2.0)).when(F.col("t_out") & F.col("t_in"), 1.0).when(F.col("t_out") | F.col("t_in"), 2.0).otherwise(0.5),
}


def applicable_weights(explicit: bool, symmetric: bool) -> list[str]:
    drop = set() if explicit else {"BIDIRECTIONAL"}
    if symmetric:
        drop |= {"NUM_OUTGOING", "NUM_OUTGOING_1P", "INCOMING_OUTGOING_LOG_RATIO"}
    return [w for w in WEIGHTS if w not in drop]


def features(spark, d: str) -> DataFrame:
    """candidate and its node features: degrees, counts, theta, sender theta and the global theta."""
    e, m = social.explicit_edges(spark, d), classified(spark, d)
    own = m.groupBy(F.col("sender").alias("candidate")).agg(F.count_if(F.col("cls") == NON_ADDR).alias("non_addr"), F.count_if(F.col("cls") == ADDR).alias("addr_out"))
    got = m.where(F.col("cls").isin(ADDR, SHARED)).groupBy(F.col("other").alias("candidate")).agg(F.count_if(F.col("cls") == SHARED).alias("got_shared"), F.count_if(F.col("cls") == ADDR).alias("addr_in"))
    t = theta(m.where(F.col("cls") == NON_ADDR), "sender").select(F.col("sender").alias("candidate"), F.col("theta").alias("c_theta"))
    s = theta(m.where(F.col("cls") == ADDR), "sender").select(F.col("sender").alias("candidate"), F.col("theta").alias("c_sender"))
    g = theta(m.where(F.col("cls") == NON_ADDR).withColumn("all", F.lit(1)), "all").select(F.col("theta").alias("g_theta"))
    f = social.users(spark, d).select(F.col("id").alias("candidate"))
    for part in (e.groupBy(F.col("dst").alias("candidate")).agg(F.count("*").alias("n_in")), e.groupBy(F.col("src").alias("candidate")).agg(F.count("*").alias("n_out")), own, got, t, s):
        f = f.join(part, "candidate", "left")
    return f.crossJoin(F.broadcast(g))  # the global distribution is one row


def weighted_mean(members: DataFrame, vectors: DataFrame, weight: Column, prior: list[float]) -> DataFrame:
    """origin, theta: the weighted mean of the candidates' vectors that exist; the prior where the weights add up to 0."""
    j = members.join(vectors, "candidate").withColumn("_w", weight).where("_w > 0 AND c_theta IS NOT NULL")
    k = len(prior)
    sums = j.groupBy("origin").agg(F.sum("_w").alias("_sw"), *[F.sum(F.col("_w") * F.col("c_theta")[i]).alias(f"_s{i}") for i in range(k)])
    got = sums.select("origin", F.array(*[F.col(f"_s{i}") / F.col("_sw") for i in range(k)]).alias("theta"))
    return members.select("origin").distinct().join(got, "origin", "left").select("origin", F.coalesce("theta", F.array(*[F.lit(p) for p in prior])).alias("theta"))


def balanced_partition(entities: DataFrame, slots: int) -> DataFrame:
    """Spread entities (id, mask of permitted slots) over their slots, the least general masks first, and cut all slots
    to the least; adds slot."""
    bits = F.expr(f"filter(sequence(0, {slots - 1}), i -> getbit(cast(mask AS bigint), i) = 1)")
    w = Window.partitionBy("mask").orderBy("id")
    e = entities.withColumn("_b", bits).where(F.size("_b") > 0).withColumn("_r", F.row_number().over(w) - 1)
    e = e.withColumn("_part", F.floor(F.count("*").over(Window.partitionBy("mask")) / F.size("_b")))
    e = e.where(F.col("_r") < F.col("_part") * F.size("_b")).withColumn("slot", F.element_at("_b", (F.floor(F.col("_r") / F.col("_part")) + 1).cast("int")))
    n = e.groupBy("slot").agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    e = e.withColumn("_k", F.row_number().over(Window.partitionBy("slot").orderBy(F.bit_count("mask"), "mask", "id"))).crossJoin(F.broadcast(n))
    return e.where(F.col("_k") <= F.col("_least")).select("id", "mask", "slot")


def best_baseline(results: DataFrame, baselines: tuple[str, ...] = ("UNIFORM", "PREVIOUS")) -> DataFrame:
    """The least error of any baseline per week, next to each variant; variants that don't beat it are discarded."""
    base = results.where(F.col("variant").isin(*baselines)).groupBy("week").agg(F.min("jsd").alias("best"))
    return results.where(~F.col("variant").isin(*baselines)).join(base, "week").withColumn("discarded", F.col("best") <= F.col("jsd"))


# Queries ----------------------------------------------------------------------------------------------------------


def comm(spark, d):
    return classified(spark, d).where(F.col("cls") == ADDR).select(F.col("sender").alias("src"), F.col("other").alias("dst")).distinct()


def indicator_sizes(spark, d):
    """Sizes of the indicators; those of two steps are counted without their pairs."""
    e, c = cut(social.explicit_edges(spark, d)), cut(comm(spark, d))
    one = lambda r: r.where("origin <> candidate").groupBy("origin").agg(F.count("*").alias("n"))
    two = lambda x, y: reach(x, y).select(F.col("src").alias("origin"), (F.col("n") - F.col("own")).alias("n")).where("n > 0")
    both = c.union(c.select("dst", "src")).distinct()
    parts = {"EXPLICIT_DISTANCE_ONE": one(explicit_one(e, c)), "EXPLICIT_DISTANCE_TWO": two(e, e), "COMMUNICATION_DISTANCE_ONE": one(comm_one(e, c)), "COMMUNICATION_DISTANCE_TWO": two(c, both)}
    out = None
    for name, p in parts.items():
        p = p.withColumn("indicator", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("indicator").agg(F.count("*").alias("origins"), F.sum("n").alias("pairs"), F.max("n").alias("most"))


def node_weights(spark, d):
    f = features(spark, d)
    names = ["NUM_INCOMING", "NUM_INCOMING_1P", "NUM_OUTGOING", "NUM_OUTGOING_1P", "INCOMING_OUTGOING_LOG_RATIO", "SHARED_RATIO", "NUM_CANDIDATE_GOT_SHARED", "CANDIDATE_NON_ADDR", "INVERSE_CANDIDATE_NON_ADDR", "CANDIDATE_ADDR", "INVERSE_CANDIDATE_ADDR", "CONSTANT"]
    return f.select("candidate", *[F.round(WEIGHTS[n](), 6).alias(n.lower()) for n in names])


def mainstream(spark, d):
    f = features(spark, d)
    return f.select("candidate", F.round(WEIGHTS["SIMILARITY_TO_MAINSTREAM"](), 6).alias("similarity"), F.round(WEIGHTS["DISTANCE_TO_MAINSTREAM"](), 6).alias("distance"), F.round(WEIGHTS["FOCUS_LEVEL"](), 6).alias("focus"))


def bidirectional(spark, d):
    e, c = social.explicit_edges(spark, d), comm(spark, d)
    flag = lambda df, a, b, n: df.select(F.col(a).alias("origin"), F.col(b).alias("candidate"), F.lit(True).alias(n))
    j = explicit_one(e, c)
    for part, n in ((flag(e, "src", "dst", "e_out"), "e_out"), (flag(e, "dst", "src", "e_in"), "e_in"), (flag(c, "src", "dst", "t_out"), "t_out"), (flag(c, "dst", "src", "t_in"), "t_in")):
        j = j.join(part, ["origin", "candidate"], "left").withColumn(n, F.coalesce(n, F.lit(False)))
    return j.select("origin", "candidate", WEIGHTS["BIDIRECTIONAL"]().alias("weight"))


def neighborhood_mean(spark, d):
    f = features(spark, d)
    m = explicit_one(social.explicit_edges(spark, d), None).where("origin <> candidate")
    return exploded(weighted_mean(m, f, WEIGHTS["NUM_INCOMING_1P"](), [0.2] * 5), ["origin"])


def weight_stats(spark, d):
    f = features(spark, d)
    m = explicit_one(social.explicit_edges(spark, d), None).join(f, "candidate").withColumn("w", WEIGHTS["SHARED_RATIO"]())
    per = m.groupBy("origin").agg(F.sum("w").alias("s"))
    a = m.agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.var_samp("w"), 6).alias("var"), F.round(F.min("w"), 6).alias("least"), F.round(F.max("w"), 6).alias("most"))
    return a.crossJoin(per.agg(F.count("*").alias("users"), F.count_if(F.col("s") == 0).alias("empty")))


def predictions(spark, d):
    """week, user, variant, jsd: uniform, previous week, mean of the followed users' previous week."""
    t = weekly_theta(spark, d)
    prev = t.select("user", (F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("week"), F.col("theta").alias("p"))
    both = t.join(prev, ["user", "week"])
    uniform = F.array(*[F.lit(0.2)] * 5)
    near = social.explicit_edges(spark, d).select(F.col("src").alias("user"), F.col("dst").alias("v")).join(prev.select(F.col("user").alias("v"), "week", F.col("p").alias("q")), "v")
    mean = near.groupBy("user", "week").agg(F.array(*[F.avg(F.col("q")[i]) for i in range(5)]).alias("q"))
    all_ = both.join(mean, ["user", "week"], "left").select("user", "week", "theta", F.explode(F.create_map(F.lit("UNIFORM"), uniform, F.lit("PREVIOUS"), F.col("p"), F.lit("NEIGHBOURS"), F.coalesce("q", uniform))).alias("variant", "guess"))
    return all_.select("user", F.date_format("week", "yyyy-MM-dd").alias("week"), "variant", V.jsd_2("theta", "guess").alias("jsd"), V.cosine("theta", "guess").alias("cosine"), V.zero_one("theta", "guess").alias("zero_one"))


def baseline_jsd(spark, d):
    return predictions(spark, d).groupBy("week", "variant").agg(F.count("*").alias("n"), F.round(F.avg("jsd"), 6).alias("jsd"), F.round(F.avg("cosine"), 6).alias("cosine"))


def best_baselines(spark, d):
    return best_baseline(baseline_jsd(spark, d)).select("week", "variant", "jsd", "best", "discarded")


def survival(spark, d):
    b = best_baselines(spark, d)
    return b.groupBy("variant").agg(F.round(F.avg((~F.col("discarded")).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


def completeness(spark, d):
    """Share of a core user's incident edges that stay among core users; -1 where there are none."""
    u = social.users(spark, d)
    e = social.explicit_edges(spark, d)
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("o")).union(e.select("dst", "src"))
    j = both.join(u.select(F.col("id").alias("o"), F.col("is_core").alias("oc")), "o").groupBy("id").agg(F.count("*").alias("n"), F.count_if("oc").alias("c"))
    r = F.when(F.col("n") <= 1, -1.0).otherwise(F.greatest(F.lit(0.0), F.col("c") - 1.0) / (F.col("n") - 1))
    return u.where("is_core").join(j, "id", "left").select("id", F.round(F.coalesce(r, F.lit(-1.0)), 6).alias("completeness"))


def pearson(spark, d):
    c = completeness(spark, d).where("completeness >= 0")
    p = predictions(spark, d).where("variant = 'PREVIOUS'").groupBy(F.col("user").alias("id")).agg(F.avg("jsd").alias("jsd"))
    return c.join(p, "id").agg(F.count("*").alias("n"), F.round(F.corr("completeness", "jsd"), 6).alias("r"))


def anova_prep(spark, d):
    m = classified(spark, d)
    mask = F.expr("bit_or(shiftleft(1L, cast(floor(datediff(ts, DATE'2024-01-01') / 7) AS int)))")
    return balanced_partition(m.groupBy(F.col("sender").alias("id")).agg(mask.alias("mask")), 5)


FE = """fe AS (SELECT u.id AS candidate, (SELECT count(*) FROM explicit_edges e WHERE e.dst = u.id) AS n_in, (SELECT count(*) FROM explicit_edges e WHERE e.src = u.id) AS n_out,
  (SELECT count(*) FROM classified m WHERE m.sender = u.id AND cls = 'NON_ADDR') AS non_addr, (SELECT count(*) FROM classified m WHERE m.sender = u.id AND cls = 'ADDR') AS addr_out,
  (SELECT count(*) FROM classified m WHERE m.other = u.id AND cls = 'SHARED') AS got_shared, (SELECT count(*) FROM classified m WHERE m.other = u.id AND cls = 'ADDR') AS addr_in FROM users u)"""
CT = "ct AS (SELECT g.sender AS u, t.k AS topic, (coalesce(w.n, 0) + 0.5) / (g.n + 2.5) AS p FROM (SELECT sender, count(*) AS n FROM classified WHERE cls = 'NON_ADDR' GROUP BY 1) g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN (SELECT sender, topic, count(*) AS n FROM classified WHERE cls = 'NON_ADDR' GROUP BY ALL) w ON w.sender = g.sender AND w.topic = t.k)"
CM = "cm AS (SELECT DISTINCT sender AS src, other AS dst FROM classified WHERE cls = 'ADDR')"
BOTH = "cb AS (SELECT src, dst FROM cm UNION SELECT dst, src FROM cm)"
WT = "wt AS (SELECT sender AS u, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05') AS week, topic, count(*) AS n FROM classified WHERE cls = 'NON_ADDR' GROUP BY ALL)"
TH = "th AS (SELECT g.u, g.week, t.k AS topic, (coalesce(w.n, 0) + 0.5) / (g.n + 2.5) AS p FROM (SELECT u, week, sum(n) AS n FROM wt GROUP BY ALL) g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN wt w ON w.u = g.u AND w.week = g.week AND w.topic = t.k)"
PD = """pv AS (SELECT u, week + INTERVAL 7 DAY AS week, topic, p FROM th),
nb AS (SELECT e.src AS u, pv.week, pv.topic, avg(pv.p) AS q FROM explicit_edges e JOIN pv ON pv.u = e.dst GROUP BY ALL),
gs AS (SELECT th.u, th.week, th.topic, th.p, v.variant, CASE v.variant WHEN 'UNIFORM' THEN 0.2 WHEN 'PREVIOUS' THEN pv.p ELSE coalesce(nb.q, 0.2) END AS g FROM th JOIN pv ON pv.u = th.u AND pv.week = th.week AND pv.topic = th.topic
  LEFT JOIN nb ON nb.u = th.u AND nb.week = th.week AND nb.topic = th.topic CROSS JOIN (SELECT unnest(['UNIFORM', 'PREVIOUS', 'NEIGHBOURS']) AS variant) v),
pd AS (SELECT u, week, variant, sum(0.5 * (p * ln(p) + g * ln(g)) - (p + g) / 2 * ln((p + g) / 2)) / ln(2) AS jsd, sum(p * g) / sqrt(sum(p * p) * sum(g * g)) AS cosine FROM gs GROUP BY ALL),
bj AS (SELECT strftime(week, '%Y-%m-%d') AS week, variant, count(*) AS n, round(avg(jsd), 6) AS jsd, round(avg(cosine), 6) AS cosine FROM pd GROUP BY ALL)"""
CO = """co AS (SELECT u.id, round(coalesce(CASE WHEN n <= 1 THEN -1.0 ELSE greatest(0, c - 1) / (n - 1) END, -1.0), 6) AS completeness FROM users u LEFT JOIN (SELECT id, count(*) AS n, count(*) FILTER (x.is_core) AS c FROM
  (SELECT src AS id, dst AS o FROM explicit_edges UNION ALL SELECT dst, src FROM explicit_edges) b JOIN (SELECT id AS o2, is_core FROM users) x ON x.o2 = b.o GROUP BY 1) j ON j.id = u.id WHERE u.is_core)"""
QUERIES = {
    "indicator_sizes": (indicator_sizes, sql("""SELECT indicator, count(*) AS origins, CAST(sum(n) AS BIGINT) AS pairs, max(n) AS most FROM (SELECT indicator, origin, count(*) AS n FROM (
      SELECT 'EXPLICIT_DISTANCE_ONE' AS indicator, src AS origin, dst AS candidate FROM explicit_edges UNION SELECT 'EXPLICIT_DISTANCE_TWO', src, dst FROM explicit_edges UNION SELECT 'EXPLICIT_DISTANCE_TWO', a.src, b.dst FROM explicit_edges a JOIN explicit_edges b ON a.dst = b.src
      UNION SELECT 'COMMUNICATION_DISTANCE_ONE', src, dst FROM cb UNION SELECT 'COMMUNICATION_DISTANCE_TWO', src, dst FROM cm UNION SELECT 'COMMUNICATION_DISTANCE_TWO', a.src, b.dst FROM cm a JOIN cb b ON a.dst = b.src) WHERE origin <> candidate GROUP BY ALL) GROUP BY 1""", CM, BOTH)),
    "node_weights": (node_weights, sql("""SELECT candidate, round(CAST(n_in AS DOUBLE), 6) AS num_incoming, round(ln(1 + n_in), 6) AS num_incoming_1p, round(CAST(n_out AS DOUBLE), 6) AS num_outgoing, round(ln(1 + n_out), 6) AS num_outgoing_1p,
      round(ln(1 + n_in) / CASE WHEN n_out > 0 THEN ln(1 + n_out) ELSE ln(2) END, 6) AS incoming_outgoing_log_ratio, round(got_shared / greatest(1, non_addr), 6) AS shared_ratio, round(CAST(got_shared AS DOUBLE), 6) AS num_candidate_got_shared,
      round(CAST(non_addr AS DOUBLE), 6) AS candidate_non_addr, round(1 / (1 + non_addr), 6) AS inverse_candidate_non_addr, round(CAST(addr_in + addr_out AS DOUBLE), 6) AS candidate_addr, round(1 / (1 + addr_in + addr_out), 6) AS inverse_candidate_addr, 1.0::DOUBLE AS constant FROM fe""", FE)),
    "mainstream": (mainstream, sql("""SELECT u.id AS candidate, coalesce(round(1 - d, 6), 0) AS similarity, coalesce(round(d, 6), 0) AS distance, coalesce(round((m - 0.1) / 0.9, 6), 0) AS focus FROM users u LEFT JOIN
      (SELECT ct.u, sum(0.5 * (p * ln(p) + g.q * ln(g.q)) - (p + g.q) / 2 * ln((p + g.q) / 2)) / ln(2) AS d, max(p) AS m FROM ct JOIN (SELECT topic, (count(*) + 0.5) / ((SELECT count(*) FROM classified WHERE cls = 'NON_ADDR') + 2.5) AS q FROM classified WHERE cls = 'NON_ADDR' GROUP BY 1) g ON g.topic = ct.topic GROUP BY 1) x ON x.u = u.id""", CT)),
    "bidirectional": (bidirectional, sql("""SELECT origin, candidate, CAST(CASE WHEN eo AND ei THEN CASE WHEN co AND ci THEN 4 ELSE 2 END WHEN co AND ci THEN 1 WHEN co OR ci THEN 2 ELSE 0.5 END AS DOUBLE) AS weight FROM (SELECT src AS origin, dst AS candidate, true AS eo, EXISTS (SELECT 1 FROM explicit_edges r WHERE r.src = e.dst AND r.dst = e.src) AS ei,
      EXISTS (SELECT 1 FROM cm WHERE cm.src = e.src AND cm.dst = e.dst) AS co, EXISTS (SELECT 1 FROM cm WHERE cm.src = e.dst AND cm.dst = e.src) AS ci FROM explicit_edges e)""", CM)),
    "neighborhood_mean": (neighborhood_mean, sql("""SELECT o.origin, CAST(t.k AS INTEGER) AS topic, round(coalesce(x.p, 0.2), 6) AS p FROM (SELECT DISTINCT src AS origin FROM explicit_edges) o CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN
      (SELECT e.src, ct.topic, sum(ln(1 + n_in) * p) / sum(ln(1 + n_in)) AS p FROM explicit_edges e JOIN fe ON fe.candidate = e.dst JOIN ct ON ct.u = e.dst WHERE n_in > 0 GROUP BY ALL) x ON x.src = o.origin AND x.topic = t.k""", FE, CT)),
    "weight_stats": (weight_stats, sql("""SELECT n, mean, var, least, most, users, empty FROM (SELECT count(*) AS n, round(avg(w), 6) AS mean, round(var_samp(w), 6) AS var, round(min(w), 6) AS least, round(max(w), 6) AS most FROM x), (SELECT count(*) AS users, count(*) FILTER (s = 0) AS empty FROM (SELECT src, sum(w) AS s FROM x GROUP BY 1))""",
      FE, "x AS (SELECT e.src, got_shared / greatest(1, non_addr) AS w FROM explicit_edges e JOIN fe ON candidate = dst)")),
    "baseline_jsd": (baseline_jsd, sql("SELECT * FROM bj", WT, TH, PD)),
    "best_baseline": (best_baselines, sql("SELECT v.week, v.variant, v.jsd, b.best, b.best <= v.jsd AS discarded FROM bj v JOIN (SELECT week, min(jsd) AS best FROM bj WHERE variant <> 'NEIGHBOURS' GROUP BY 1) b USING (week) WHERE v.variant = 'NEIGHBOURS'", WT, TH, PD)),
    "survival": (survival, sql("SELECT v.variant, round(avg(CASE WHEN b.best <= v.jsd THEN 0.0 ELSE 1.0 END), 6) AS rate, count(*) AS n FROM bj v JOIN (SELECT week, min(jsd) AS best FROM bj WHERE variant <> 'NEIGHBOURS' GROUP BY 1) b USING (week) WHERE v.variant = 'NEIGHBOURS' GROUP BY 1", WT, TH, PD)),
    "completeness": (completeness, sql("SELECT id, completeness FROM co", CO)),
    "pearson": (pearson, sql("SELECT count(*) AS n, round(corr(completeness, jsd), 6) AS r FROM co JOIN (SELECT u, avg(jsd) AS jsd FROM pd WHERE variant = 'PREVIOUS' GROUP BY 1) p ON p.u = co.id WHERE completeness >= 0", CO, WT, TH, PD)),
    "anova_prep": (anova_prep, sql("""SELECT id, mask, CAST(slot AS INTEGER) AS slot FROM (SELECT *, min(n) OVER () AS least FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY bit_count(mask), mask, id) AS k, count(*) OVER (PARTITION BY slot) AS n FROM
      (SELECT id, mask, b[1 + r // part] AS slot FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY mask) // len(b) AS part FROM (SELECT id, mask, list_filter([0, 1, 2, 3, 4], lambda i: (mask >> i) & 1 = 1) AS b FROM an)) WHERE r < part * len(b)))) WHERE k <= least""",
      "an AS (SELECT sender AS id, bit_or(CAST(1 << (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7) AS BIGINT)) AS mask FROM messages GROUP BY 1)")),
}
