"""Eligibility, feature assembly with fallbacks, neighbourhood grids, and the reports that judge models of who follows whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.functions import vectors as V
from quern.operators.graphs import components, induced, maximal_cliques
from quern.operators.messages import ADDR, NON_ADDR, SHARED, classified, links
from quern.operators.neighbourhood import BOTH, CM, CO, CT, FE, PD, WEIGHTS, balanced_partition, baseline_jsd, comm, comm_one, completeness, explicit_one, features, predictions, weighted_mean
from quern.operators.tables import cut, folder
from quern.operators.theta import CENTERS, CH, COMPLEMENT, IV, LENGTHS, TH, WT, complement_edges, intervals, lagged_similarity, similar, sliced, theta, week_steps, weekly_theta
from quern.operators.windows import LK, RT, roots
from quern.sources import social
from quern.sources.social import TOPICS, sql

r6 = lambda x: F.round(x, 6)
PRIOR = [1.0 / TOPICS] * TOPICS


def prior() -> Column:
    return F.array(*[F.lit(p) for p in PRIOR])


# Eligibility --------------------------------------------------------------------------------------------------------


def eligible(theta_slices: DataFrame, *keys: str) -> DataFrame:
    """keys, mask: bit i is set if the entity has a distribution both before and after centre date i; theta_slices: keys, center, sign."""
    both = theta_slices.groupBy(*keys, "center").agg(F.countDistinct("sign").alias("k")).where("k = 2")
    at = F.array_position(F.array(*[F.lit(x) for x in CENTERS]), F.col("center")) - 1
    return both.withColumn("i", at).groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(1L, cast(i AS int))")).alias("mask"))


def eligible_nodes(spark, d):
    m = sliced(classified(spark, d).where(F.col("cls") == NON_ADDR), intervals(spark, lengths=(2,)))
    return eligible(m.select(F.col("sender").alias("id"), "center", "sign"), "id")


def eligible_edges(spark, d):
    """Edges of communication with both ends core."""
    core = social.users(spark, d).where("is_core")
    m = sliced(classified(spark, d).where(F.col("cls") == ADDR), intervals(spark, lengths=(7,))).select(F.col("sender").alias("src"), F.col("other").alias("dst"), "center", "sign")
    m = m.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi")
    return eligible(m, "src", "dst")


def partition_slots(spark, d):
    """Eligible nodes spread over the centre dates they may be tested at."""
    return balanced_partition(eligible_nodes(spark, d), len(CENTERS))


def observed_steps(spark, d) -> DataFrame:
    """src, dst, steps: weeks at which both ends of an explicit edge have a distribution (0 included)."""
    w = week_steps(spark, d)
    e = social.explicit_edges(spark, d)
    n = e.join(w.select(F.col("user").alias("dst"), "i"), "dst").join(w.select(F.col("user").alias("src"), "i"), ["src", "i"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("steps"))
    return e.join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("steps", F.lit(0)).alias("steps"))


def enough_steps(steps: Column, total: int, least: int, share: float) -> Column:
    return (steps > least) & (steps / total > share)


def enough_observations(spark, d):
    return observed_steps(spark, d).where(enough_steps(F.col("steps"), 5, 2, 0.7))


def granger_counters(spark, d):
    """What the preparation of causality tests leaves: edges, edges with enough steps, and their steps."""
    s = observed_steps(spark, d).withColumn("ok", enough_steps(F.col("steps"), 5, 2, 0.7))
    return s.agg(F.count("*").alias("edges"), F.count_if("ok").alias("kept"), F.count_if(F.col("steps") == 0).alias("without"), r6(F.avg(F.when(F.col("ok"), F.col("steps")))).alias("mean"), r6(F.stddev_samp(F.when(F.col("ok"), F.col("steps")))).alias("sd"), F.max("steps").alias("most"))


def influencer_fill(spark, d):
    """Series of the source with its last step put in from the one before, as the target's last step has no use for it."""
    t = weekly_theta(spark, d).select("user", "week", r6(F.array_max("theta")).alias("p"))
    w = Window.partitionBy("user").orderBy("week")
    last = F.lead("week").over(w).isNull()
    return t.select("user", F.date_format("week", "yyyy-MM-dd").alias("week"), F.when(last, F.coalesce(F.lag("p").over(w), F.col("p"))).otherwise(F.col("p")).alias("p"))


# Features with fallbacks ------------------------------------------------------------------------------------------------


def slice_thetas(m: DataFrame, slices: DataFrame, *keys: str) -> DataFrame:
    """keys, center, len, sign, theta."""
    return theta(sliced(m, slices), *keys, "center", "len", "sign")


def with_fallback(entities: DataFrame, thetas: DataFrame, length: int, longest: int, *keys: str) -> DataFrame:
    """entities (keys, center, sign) with theta: that of ``length`` days, else of the longest slice, else the prior."""
    pick = lambda n, name: thetas.where(F.col("len") == n).select(*keys, "center", "sign", F.col("theta").alias(name))
    j = entities.join(pick(length, "_a"), [*keys, "center", "sign"], "left").join(pick(longest, "_b"), [*keys, "center", "sign"], "left")
    return j.withColumn("theta", F.coalesce("_a", "_b", prior())).withColumn("source", F.when(F.col("_a").isNotNull(), "own").when(F.col("_b").isNotNull(), "longest").otherwise("prior")).drop("_a", "_b")


def node_features(spark, d):
    """Of every core user at each centre date, in order: own, addressed and received topics of two days before (observed) and after
    (to predict), with the week as fallback."""
    m, iv = classified(spark, d), intervals(spark, lengths=(2, 7))
    ids = social.users(spark, d).where("is_core").select("id").crossJoin(F.broadcast(intervals(spark, lengths=(2,)).select("center", "sign")))  # six rows
    roles = (("own", m.where(F.col("cls") == NON_ADDR).withColumn("id", F.col("sender"))), ("addressed", m.where(F.col("cls") == ADDR).withColumn("id", F.col("sender"))), ("received", m.where(F.col("cls") == ADDR).withColumn("id", F.col("other"))))
    out = None
    for k, (role, x) in enumerate(roles):
        f = with_fallback(ids, slice_thetas(x, iv, "id"), 2, 7, "id").select("id", "center", "sign", F.lit(k).alias("k"), F.lit(role).alias("role"), "theta", "source")
        out = f if out is None else out.unionByName(f)
    return out


def feature_assembly(spark, d):
    f = node_features(spark, d)
    return f.select("id", "center", "sign", "role", "source", F.posexplode("theta").alias("topic", "p")).groupBy("center", "sign", "role", "source", "topic").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("p"))


def feature_matrix(spark, d):
    """The features as one array of vectors a user and date, order kept; with time reversed past and future change places."""
    f = node_features(spark, d).groupBy("id", "center", "sign").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "theta"))), lambda x: x["theta"]).alias("x"))
    both = f.where("sign < 0").select("id", "center", F.col("x").alias("past")).join(f.where("sign > 0").select("id", "center", F.col("x").alias("future")), ["id", "center"])
    one = lambda a, b, name: both.select("id", "center", F.lit(name).alias("direction"), F.size(a).alias("vars"), r6(V.jsd_2(F.get(F.col(a), F.lit(0)), F.get(F.col(b), F.lit(0)))).alias("change"), r6(F.get(F.get(F.col(a), F.lit(2)), F.lit(0))).alias("first"))
    return one("past", "future", "forward").unionByName(one("future", "past", "reversed"))


def neighborhood_sources(spark, d):
    """Weighted means of the four sources over the followed users in the week before 2024-01-15: what they sent to the user, what the
    user sent to them, their own and their addressed topics; where none has one, the prior."""
    m = sliced(classified(spark, d), intervals(spark, centers=(CENTERS[1],), lengths=(7,)).where("sign < 0"))
    near = cut(explicit_one(social.explicit_edges(spark, d), None).where("origin <> candidate").join(features(spark, d).select("candidate", "n_in"), "candidate"))
    a = m.where(F.col("cls") == ADDR)
    sources = {"incoming": theta(a, "other", "sender").select(F.col("other").alias("origin"), F.col("sender").alias("candidate"), F.col("theta").alias("c_theta")), "outgoing": theta(a, "sender", "other").select(F.col("sender").alias("origin"), F.col("other").alias("candidate"), F.col("theta").alias("c_theta")),
               "own": theta(m.where(F.col("cls") == NON_ADDR), "sender").select(F.col("sender").alias("candidate"), F.col("theta").alias("c_theta")), "addressed": theta(a, "sender").select(F.col("sender").alias("candidate"), F.col("theta").alias("c_theta"))}
    out = None
    for name, v in sources.items():
        if "origin" in v.columns:
            v = near.select("origin", "candidate").join(v, ["origin", "candidate"])
            mean = weighted_mean(near.withColumn("candidate", F.struct("origin", "candidate")), v.select(F.struct("origin", "candidate").alias("candidate"), "c_theta"), WEIGHTS["NUM_INCOMING_1P"](), PRIOR)
        else:
            mean = weighted_mean(near, v, WEIGHTS["NUM_INCOMING_1P"](), PRIOR)
        x = mean.select("origin", F.lit(name).alias("source"), F.posexplode("theta").alias("topic", "p"))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("p", r6("p"))


def baselines(spark, d):
    """Errors of the four fixed predictions of a user's week: the prior, the week before, equal shares of three sources, and no
    neighbours at all (the user's own week before and the mean of all users, half each)."""
    t = weekly_theta(spark, d)
    prev = t.select("user", (F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("week"), F.col("theta").alias("p"))
    mean = t.groupBy("week").agg(F.array(*[F.avg(F.col("theta")[i]) for i in range(TOPICS)]).alias("g")).select((F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("week"), "g")
    x = t.join(prev, ["user", "week"]).join(F.broadcast(mean), "week")  # a row per week
    mix = lambda *cs: F.transform(F.arrays_zip(*cs), lambda z: sum(z[c] for c in cs) / len(cs))
    x = x.withColumn("u", prior())
    g = x.select("user", "week", "theta", F.explode(F.create_map(F.lit("UNIFORM"), F.col("u"), F.lit("PREVIOUS"), F.col("p"), F.lit("CONST_COEFF"), mix("u", "p", "g"), F.lit("EMPTY_NEIGHBORHOOD"), mix("p", "g"))).alias("variant", "guess"))
    return g.groupBy(F.date_format("week", "yyyy-MM-dd").alias("week"), "variant").agg(F.count("*").alias("n"), r6(F.avg(V.jsd_2("theta", "guess"))).alias("jsd"))


# Reports ----------------------------------------------------------------------------------------------------------------


def baseline_errors(spark, d):
    p = predictions(spark, d)
    return p.groupBy("week", "variant").agg(r6(F.avg("jsd")).alias("jsd"), r6(F.avg("cosine")).alias("cosine"), r6(F.avg("zero_one")).alias("zero_one"))


def anova_variants(spark, d):
    """Variants for the analysis: the fitted one is named SCIM, baselines stay, and a variant discarded in a week goes; one that is
    discarded in over half of its weeks goes altogether."""
    b = baseline_jsd(spark, d)
    base = b.where("variant <> 'NEIGHBOURS'").groupBy("week").agg(F.min("jsd").alias("best"))
    gone = b.where("variant = 'NEIGHBOURS'").join(base, "week").withColumn("out", F.col("best") * 2 <= F.col("jsd"))
    exact = gone.where("out").select("week", "variant")
    general = gone.groupBy("variant").agg(F.avg(F.col("out").cast("int")).alias("s")).where("s > 0.5").select("variant")
    kept = b.join(exact, ["week", "variant"], "left_anti").join(general, "variant", "left_anti")
    return kept.select("week", F.when(F.col("variant") == "NEIGHBOURS", "SCIM").otherwise(F.col("variant")).alias("variant"), "jsd")


GRID = {"EXPLICIT_DISTANCE_ONE": ("CONSTANT", "NUM_INCOMING_1P", "SHARED_RATIO"), "COMMUNICATION_DISTANCE_ONE": ("CONSTANT", "NUM_INCOMING_1P", "SHARED_RATIO")}


def neighborhood_grid(spark, d) -> DataFrame:
    """indicator, weight, users, empty, jsd: how far the weighted mean of each neighbourhood is from the user's own topics."""
    f = cut(features(spark, d))
    own = f.select(F.col("candidate").alias("origin"), F.col("c_theta").alias("own")).where("own IS NOT NULL")
    rel = {"EXPLICIT_DISTANCE_ONE": explicit_one, "COMMUNICATION_DISTANCE_ONE": comm_one}
    e, c, out = social.explicit_edges(spark, d), comm(spark, d), None
    for indicator, weights in GRID.items():
        near = cut(rel[indicator](e, c).where("origin <> candidate"))
        for w in weights:
            mean = weighted_mean(near, f, WEIGHTS[w](), PRIOR).join(own, "origin")
            sums = near.join(f, "candidate").groupBy("origin").agg(F.sum(WEIGHTS[w]()).alias("s"))
            x = mean.join(sums, "origin").agg(F.count("*").alias("users"), F.count_if(F.col("s") == 0).alias("empty"), r6(F.avg(V.jsd_2("own", "theta"))).alias("jsd"), r6(F.stddev_samp(V.jsd_2("own", "theta"))).alias("sd"))
            x = x.select(F.lit(indicator).alias("indicator"), F.lit(w).alias("weight"), "users", "empty", "jsd", "sd")
            out = x if out is None else out.unionByName(x)
    return out


def weight_missing(spark, d):
    """Share of users whose weights are all 0, by indicator and by weight."""
    g = cut(neighborhood_grid(spark, d)).withColumn("r", F.col("empty") / F.col("users"))
    by = lambda c: g.groupBy(F.col(c).alias("name")).agg(r6(F.avg("r")).alias("rate"), r6(F.coalesce(F.stddev_samp("r"), F.lit(0.0))).alias("sd"))
    return by("indicator").unionByName(by("weight"))


def grid_survival(spark, d):
    """Of each indicator the share of weights, of each weight the share of indicators whose neighbourhood beats the middle one."""
    g = cut(neighborhood_grid(spark, d))
    kept = g.crossJoin(F.broadcast(g.agg(F.percentile("jsd", F.lit(0.5)).alias("mid")))).where("jsd <= mid")  # one row
    ni, nw = len(GRID), len(next(iter(GRID.values())))
    by = lambda c, other, n: g.select(F.col(c).alias("name")).distinct().join(kept.groupBy(F.col(c).alias("name")).agg(F.countDistinct(other).alias("k")), "name", "left").select("name", r6(F.coalesce("k", F.lit(0)) / n).alias("rate"))
    return by("indicator", "weight", nw).unionByName(by("weight", "indicator", ni))


def best_subset(spark, d):
    """Neighbourhoods named in a file of (indicator, weight)."""
    path = folder(spark, "subset")
    spark.createDataFrame([("EXPLICIT_DISTANCE_ONE", "CONSTANT"), ("COMMUNICATION_DISTANCE_ONE", "SHARED_RATIO"), ("CLIQUE", "CONSTANT")], "indicator string, weight string").write.option("header", True).csv(path, sep=";")
    return neighborhood_grid(spark, d).join(spark.read.csv(path, sep=";", header=True), ["indicator", "weight"], "left_semi").select("indicator", "weight", "users", "jsd")


def tree_json(spark, d):
    """The grid as one tree of JSON an indicator, for a Sankey plot."""
    g = neighborhood_grid(spark, d).groupBy("indicator").agg(F.sort_array(F.collect_list(F.struct(F.col("weight").alias("name"), F.col("users").alias("value")))).alias("children"))
    return g.select(F.to_json(F.struct(F.col("indicator").alias("name"), "children")).alias("json"))


def coefficient_report(coefficients: DataFrame, groups: dict[str, str]) -> DataFrame:
    """name, n, mean, var, sd of each coefficient, of the groups' sums (sd from the variances added up), and of what is left of 1.
    coefficients: one column for each key of ``groups``, which names its group."""
    names = list(groups)
    long = coefficients.select(*[F.col(n).cast("double") for n in names], (1 - sum(F.col(n) for n in names)).cast("double").alias("residual")).unpivot([], [*names, "residual"], "name", "x")
    per = cut(long.groupBy("name").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var")))
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    sums = per.where("name <> 'residual'").groupBy(F.concat(F.lit("group "), pairs[F.col("name")]).alias("name")).agg(F.max("n").alias("n"), F.sum("mean").alias("mean"), F.sum("var").alias("var"))
    return per.unionByName(sums).select("name", "n", r6("mean").alias("mean"), r6("var").alias("var"), r6(F.sqrt("var")).alias("sd"))


def coefficients(spark, d):
    """Shares of a user's messages by kind, as coefficients of scopes direct and open."""
    m = classified(spark, d).groupBy("sender").agg(*[(F.count_if(c) / F.count("*")).alias(n) for n, c in (("addressed", F.col("cls") == ADDR), ("shared", F.col("cls") == SHARED), ("viewed", F.col("event_type") == "view"))])
    return coefficient_report(m, {"addressed": "direct", "shared": "direct", "viewed": "open"})


def correlations(spark, d):
    """Pearson correlations of completeness with the users' errors, with two-sided p-values of Student's t."""
    c = completeness(spark, d).where("completeness >= 0")
    p = predictions(spark, d).groupBy(F.col("user").alias("id"), "variant").agg(F.avg("jsd").alias("jsd"))
    rows = c.join(p, "id").groupBy("variant").agg(F.count("*").alias("n"), F.corr("completeness", "jsd").alias("r")).collect()  # a row per variant
    out = []
    for v, n, r in rows:
        out.append((v, n, round(r, 6), round(float(K.t_test(r, n)), 4)))
    return spark.createDataFrame(out, "variant string, n long, r double, p double")


def training_errors(spark, d):
    """Baselines beside each other: means of the weeks' mean errors, with the pooled deviation sqrt(sum of sd^2) / n."""
    w = predictions(spark, d).groupBy("variant", "week").agg(F.avg("jsd").alias("m"), F.stddev_samp("jsd").alias("sd"))
    return w.groupBy("variant").agg(F.count("*").alias("weeks"), r6(F.avg("m")).alias("mean"), r6(F.sqrt(F.sum(F.col("sd") * F.col("sd"))) / F.count("*")).alias("pooled"))


def marginal_means(spark, d):
    """Variants by week: the table of cell means that a repeated-measures analysis starts from, and the row means."""
    b = predictions(spark, d).groupBy("week").pivot("variant", ["UNIFORM", "PREVIOUS", "NEIGHBOURS"]).agg(r6(F.avg("jsd")))
    return b.select("week", *[F.col(v).alias(v.lower()) for v in ("UNIFORM", "PREVIOUS", "NEIGHBOURS")])


def homogeneous_subsets(means: DataFrame, nearest: float) -> DataFrame:
    """subset (its members joined by ,), id, mean: maximal groups of ids whose means all differ by less than ``nearest``: the maximal
    cliques of the closeness graph, with those that are close to nobody alone. means: id, mean, one row per group mean."""
    x, y = means.alias("x"), means.alias("y")
    close = cut(x.join(y, (F.abs(F.col("x.mean") - F.col("y.mean")) < nearest) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("src"), F.col("y.id").alias("dst")))
    alone = means.join(close.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti").select(F.array("id").alias("members"))
    sets = maximal_cliques(close).unionByName(alone)
    named = sets.select(F.array_join(F.transform("members", lambda v: v.cast("string")), ",").alias("subset"), F.explode("members").alias("id"))
    return named.join(means, "id").select("subset", "id", "mean")


def day_errors(spark, d) -> DataFrame:
    """id (days since 2024-01-01 of the week's start), mean: errors of the week before as a prediction."""
    b = baseline_jsd(spark, d).where("variant = 'PREVIOUS'")
    return b.select(F.datediff(F.to_date("week"), F.lit("2024-01-01").cast("date")).cast("long").alias("id"), F.col("jsd").alias("mean"))


def homogeneous(spark, d):
    return homogeneous_subsets(day_errors(spark, d), 0.02)


def homogeneous_days(spark, d):
    """The same over days and topics: mean values of events, days that differ by less than 3."""
    e = social.table(spark, d, "events").groupBy(F.dayofmonth("ts").cast("long").alias("id")).agg(F.round(F.avg("value"), 3).alias("mean"))
    return homogeneous_subsets(e, 3.0)


def entropy_by_interval(spark, d):
    """Mean entropy of nodes' and edges' topics in every slice, and the share of all that have any."""
    m, iv = classified(spark, d), intervals(spark)
    nodes = slice_thetas(m.where(F.col("cls") == NON_ADDR), iv, "sender").withColumn("kind", F.lit("node"))
    edges = slice_thetas(m.where(F.col("cls") == ADDR), iv, "sender", "other").withColumn("kind", F.lit("edge"))
    size = social.users(spark, d).agg(F.count("*").alias("total")).withColumn("kind", F.lit("node")).unionByName(comm(spark, d).agg(F.count("*").alias("total")).withColumn("kind", F.lit("edge")))
    cols = ["kind", "center", "len", "sign", "theta"]
    g = nodes.select(cols).unionByName(edges.select(cols)).groupBy("kind", "center", "len", "sign").agg(F.count("*").alias("n"), r6(F.avg(V.entropy("theta"))).alias("entropy"))
    return g.join(F.broadcast(size), "kind").select("kind", "center", "len", "sign", "n", "entropy", r6(F.col("n") / F.col("total")).alias("active"))  # two rows


def missing_by_length(spark, d):
    """By slice length, mean and sd over users of the share of slices without a message."""
    m = sliced(classified(spark, d).where(F.col("cls") == NON_ADDR), intervals(spark))
    got = m.groupBy("sender", "len").agg(F.countDistinct("center", "sign").alias("k"))
    grid = social.users(spark, d).select(F.col("id").alias("sender")).crossJoin(F.broadcast(spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in LENGTHS])).alias("len"))))  # three rows
    r = grid.join(got, ["sender", "len"], "left").select("len", (1 - F.coalesce("k", F.lit(0)) / (2.0 * len(CENTERS))).alias("r"))
    return r.groupBy("len").agg(r6(F.avg("r")).alias("mean"), r6(F.stddev_samp("r")).alias("sd"))


def indegree_stats(spark, d):
    """Mean and sd of the in-degree over users, by network."""
    nets = social.explicit_edges(spark, d).withColumn("net", F.lit("explicit")).unionByName(social.purchase_edges(spark, d).withColumn("net", F.lit("purchase"))).unionByName(comm(spark, d).withColumn("net", F.lit("comm")))
    deg = nets.groupBy("net", "dst").agg(F.count("*").alias("k"))
    n = social.users(spark, d).agg(F.count("*").alias("n"))  # one row
    s = deg.groupBy("net").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q")).crossJoin(F.broadcast(n))
    return s.select("net", r6(F.col("s") / F.col("n")).alias("mean"), r6(F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))).alias("sd"))


def scored(spark, d) -> tuple[DataFrame, DataFrame]:
    """(explicit, complement) edges with similarity and active steps."""
    e, t = social.explicit_edges(spark, d), cut(weekly_theta(spark, d))
    return lagged_similarity(e, t, 5), lagged_similarity(complement_edges(social.users(spark, d).select("id"), e, 200), t, 5)


def coverage(spark, d):
    """Of the explicit and of the complement edges: how many reach a similarity of 0.05, and how many are rejected before for want of a step."""
    real, fake = scored(spark, d)
    one = lambda x, name: x.agg(F.count("*").alias("edges"), F.count_if(F.col("similarity") >= 0.05).alias("found"), F.count_if(F.col("active") == 0).alias("early")).select(F.lit(name).alias("network"), "edges", "found", r6(F.col("found") / F.col("edges")).alias("coverage"), r6(F.col("early") / F.col("edges")).alias("early_rate"))
    return one(real, "explicit").unionByName(one(fake, "complement"))


def network_evaluation(spark, d):
    """Replies as guesses of the explicit edges: precision, specificity on pairs without an edge, the recall these bound, and the share
    of found edges that start at a bot (every 17th user)."""
    pos, found = social.explicit_edges(spark, d), cut(social.purchase_edges(spark, d))
    neg = complement_edges(social.users(spark, d).select("id"), pos, 200)
    n = found.join(pos.withColumn("p", F.lit(1)), ["src", "dst"], "left").agg(F.count("*").alias("found"), F.count("p").alias("tp"), F.count_if(F.col("src") % 17 == 0).alias("bots"))
    m = neg.join(found.withColumn("f", F.lit(1)), ["src", "dst"], "left").agg(F.count("*").alias("neg"), F.count("f").alias("fp"))
    p, s = F.col("tp") / F.col("found"), (F.col("neg") - F.col("fp")) / F.col("neg")
    return n.crossJoin(m).select(r6(p).alias("precision"), r6(s).alias("specificity"), r6((1 - s) * (F.col("neg") - 1) / (1 / p - 1)).alias("recall"), r6(F.col("bots") / F.col("found")).alias("bots"))  # one row each


def similarity_by_influencee(spark, d):
    s = lagged_similarity(social.explicit_edges(spark, d), weekly_theta(spark, d), 5)
    return s.groupBy("dst").agg(F.count("*").alias("n"), r6(F.avg("similarity")).alias("mean"), r6(F.coalesce(F.stddev_samp("similarity"), F.lit(0.0))).alias("sd"), r6(F.max("similarity")).alias("most"))


def best_step(spark, d):
    """The week that gives most to an edge's similarity; the last of equals."""
    from quern.operators.theta import change_series

    c = cut(change_series(weekly_theta(spark, d)))
    src = c.select(F.col("user").alias("src"), (F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("week"), F.col("theta").alias("_s"))
    dst = c.where("direction IS NOT NULL").select(F.col("user").alias("dst"), "week", F.col("direction").alias("_d"), "magnitude")
    at = social.explicit_edges(spark, d).join(dst, "dst").join(src, ["src", "week"])
    gain = F.round(F.col("magnitude") * F.greatest(F.lit(0.0), V.LN2 - V.jsd_e("_s", "_d")), 6)
    return at.groupBy("src", "dst").agg(F.max(F.struct(gain.alias("g"), "week")).alias("b")).select("src", "dst", F.date_format("b.week", "yyyy-MM-dd").alias("week"), F.col("b.g").alias("gain"))


def exposer_sets(spark, d):
    """Who exposed a user to messages in each slice."""
    m = sliced(classified(spark, d).where(F.col("cls") == ADDR), intervals(spark))
    g = m.groupBy("center", "len", "sign", F.col("other").alias("user")).agg(F.sort_array(F.collect_set("sender")).alias("s"))
    return g.select("center", "len", "sign", "user", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("exposers"))


def chain_statistics(spark, d):
    """One row: chains, share of incomplete ones, lengths, and how many are at most ten long."""
    link = cut(links(social.messages(spark, d)))
    r = roots(link).groupBy("root").agg(F.count("*").alias("size"))
    x = r.join(link.where("incomplete").select(F.col("child").alias("root"), F.lit(1).alias("inc")), "root", "left")
    return x.agg(F.count("*").alias("chains"), r6(F.count("inc") / F.count("*")).alias("incomplete"), r6(F.avg("size")).alias("mean"), r6(F.stddev_samp("size")).alias("sd"), F.min("size").alias("least"), F.max("size").alias("most"), F.count_if(F.col("size") <= 10).alias("short"))


def chain_histogram(spark, d):
    """Chains by length up to ten."""
    return roots(links(social.messages(spark, d))).groupBy("root").agg(F.count("*").alias("size")).where("size <= 10").groupBy("size").agg(F.count("*").alias("n"))


def distinct_models(spark, d):
    """Parameter sets that differ: of users with the same rounded shares one stays."""
    m = classified(spark, d).groupBy("sender").agg(F.array(*[F.round(F.count_if(F.col("cls") == c) / F.count("*"), 1) for c in (ADDR, SHARED)]).alias("start"))
    x = m.select(F.array(F.col("start"), F.reverse("start")).alias("move")).dropDuplicates(["move"])
    return x.select(F.col("move")[0][0].alias("a"), F.col("move")[0][1].alias("b"))


def shuffled_sequences(spark, d):
    """Sequences of a pair in an order that a hash sets, as a control: predecessor and successor of each message."""
    m = classified(spark, d).where(F.col("cls") == ADDR)
    w = Window.partitionBy("sender", "other").orderBy(F.md5(F.concat(F.lit("s"), "id")))
    return m.select("id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def reindexed_sequences(spark, d):
    """Messages of pairs that have more than one, numbered anew over all in the order of pair and time, with the numbers around them."""
    m = classified(spark, d).where(F.col("cls") == ADDR)
    m = m.join(m.groupBy("sender", "other").agg(F.count("*").alias("n")).where("n > 1"), ["sender", "other"])
    from quern.operators.tables import ranked

    x = ranked(m.select("sender", "other", "ts", "id"), "sender", "other", "ts", "id")
    w = Window.partitionBy("sender", "other").orderBy("rank")
    return x.select("id", "rank", F.lag("rank").over(w).alias("prev"), F.lead("rank").over(w).alias("next"))


def disjoint_recipients(spark, d):
    """Users none of whose addressees they follow."""
    a = classified(spark, d).where(F.col("cls") == ADDR).groupBy(F.col("sender").alias("id")).agg(F.collect_set("other").alias("to"))
    f = social.explicit_edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("follows"))
    return a.join(f, "id").where(~F.arrays_overlap("to", "follows")).select("id", F.size("to").alias("n"))


def core_components(spark, d):
    """Components of the explicit edges among every seventh user."""
    return components(induced(social.explicit_edges(spark, d), social.users(spark, d).where("id % 7 = 0")))


WS = "ws AS (SELECT DISTINCT u, date_diff('day', DATE '2024-01-01', CAST(week AS DATE)) // 7 AS i FROM wt)"
OS = "os AS (SELECT e.src, e.dst, count(b.i) AS steps FROM explicit_edges e LEFT JOIN ws a ON a.u = e.src LEFT JOIN ws b ON b.u = e.dst AND b.i = a.i GROUP BY ALL)"
IVX = IV + ",\nci AS (SELECT c, i FROM (VALUES ('2024-01-22', 0), ('2024-01-15', 1), ('2024-01-08', 2)) t(c, i))"
EN = "en AS (SELECT id, CAST(sum(1 << i) AS BIGINT) AS mask FROM (SELECT sender AS id, center FROM classified JOIN iv ON ts > a AND ts <= b WHERE cls = 'NON_ADDR' AND len = 2 GROUP BY ALL HAVING count(DISTINCT sign) = 2) JOIN ci ON c = center GROUP BY 1)"
ROLES = """ro AS (SELECT 'own' AS role, sender AS id, ts, topic FROM classified WHERE cls = 'NON_ADDR' UNION ALL SELECT 'addressed', sender, ts, topic FROM classified WHERE cls = 'ADDR' UNION ALL SELECT 'received', other, ts, topic FROM classified WHERE cls = 'ADDR'),
rc AS (SELECT role, id, center, len, sign, topic, count(*) AS n FROM ro JOIN iv ON ts > a AND ts <= b WHERE len IN (2, 7) GROUP BY ALL),
rn AS (SELECT role, id, center, len, sign, sum(n) AS n FROM rc GROUP BY ALL),
rt2 AS (SELECT g.role, g.id, g.center, g.len, g.sign, t.k AS topic, (coalesce(rc.n, 0) + 0.5) / (g.n + 2.5) AS p FROM rn g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN rc ON rc.role = g.role AND rc.id = g.id AND rc.center = g.center AND rc.len = g.len AND rc.sign = g.sign AND rc.topic = t.k),
rf AS (SELECT u.id, c.c AS center, s.sign, r.role, r.k, t.k AS topic, coalesce(x.p, y.p, 0.2) AS p, CASE WHEN x.p IS NOT NULL THEN 'own' WHEN y.p IS NOT NULL THEN 'longest' ELSE 'prior' END AS source FROM (SELECT id FROM users WHERE is_core) u CROSS JOIN ci c CROSS JOIN (SELECT unnest([-1, 1]) AS sign) s
  CROSS JOIN (VALUES ('own', 0), ('addressed', 1), ('received', 2)) r(role, k) CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN rt2 x ON x.role = r.role AND x.id = u.id AND x.center = c.c AND x.sign = s.sign AND x.len = 2 AND x.topic = t.k LEFT JOIN rt2 y ON y.role = r.role AND y.id = u.id AND y.center = c.c AND y.sign = s.sign AND y.len = 7 AND y.topic = t.k)"""
WK = "wk AS (SELECT * FROM classified JOIN iv ON ts > a AND ts <= b WHERE center = '2024-01-15' AND len = 7 AND sign = -1)"


def pair_p(name: str, keys: str, cond: str) -> str:
    on = " AND ".join(f"w.{k} = g.{k}" for k in keys.split(", "))
    gk = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"{name} AS (SELECT {gk}, t.k AS topic, (coalesce(w.n, 0) + 0.5) / (g.n + 2.5) AS p FROM (SELECT {keys}, count(*) AS n FROM wk WHERE {cond} GROUP BY ALL) g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN (SELECT {keys}, topic, count(*) AS n FROM wk WHERE {cond} GROUP BY ALL) w ON {on} AND w.topic = t.k)"


NS = ",\n".join([pair_p("pe", "sender, other", "cls = 'ADDR'"), pair_p("po", "sender", "cls = 'NON_ADDR'"), pair_p("pa", "sender", "cls = 'ADDR'"),
    """sr AS (SELECT 'incoming' AS source, other AS o, sender AS c, topic, p FROM pe UNION ALL SELECT 'outgoing', sender, other, topic, p FROM pe UNION ALL SELECT 'own', e.src, po.sender, topic, p FROM explicit_edges e JOIN po ON po.sender = e.dst UNION ALL SELECT 'addressed', e.src, pa.sender, topic, p FROM explicit_edges e JOIN pa ON pa.sender = e.dst),
    sm AS (SELECT source, e.src AS origin, topic, sum(ln(1 + n_in) * p) / sum(ln(1 + n_in)) AS p FROM sr JOIN explicit_edges e ON e.src = o AND e.dst = c JOIN fe ON fe.candidate = c WHERE n_in > 0 GROUP BY ALL)"""])
GR = """wf AS (SELECT candidate, 1.0::DOUBLE AS w0, ln(1 + n_in) AS w1, got_shared / greatest(1, non_addr) AS w2 FROM fe),
nr AS (SELECT 'EXPLICIT_DISTANCE_ONE' AS indicator, src AS o, dst AS c FROM explicit_edges UNION ALL SELECT 'COMMUNICATION_DISTANCE_ONE', src, dst FROM cb WHERE src <> dst),
nw AS (SELECT indicator, o, c, u.name AS weight, CASE u.i WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END AS w FROM nr JOIN wf ON candidate = c CROSS JOIN (VALUES ('CONSTANT', 0), ('NUM_INCOMING_1P', 1), ('SHARED_RATIO', 2)) u(name, i)),
nm AS (SELECT indicator, weight, o, topic, sum(w * p) / sum(w) AS p FROM nw JOIN ct ON ct.u = c WHERE w > 0 GROUP BY ALL),
ng AS (SELECT g.indicator, g.weight, g.o, g.s, sum(0.5 * (x.p * ln(x.p) + coalesce(nm.p, 0.2) * ln(coalesce(nm.p, 0.2))) - (x.p + coalesce(nm.p, 0.2)) / 2 * ln((x.p + coalesce(nm.p, 0.2)) / 2)) / ln(2) AS j FROM (SELECT indicator, weight, o, sum(w) AS s FROM nw GROUP BY ALL) g JOIN ct x ON x.u = g.o LEFT JOIN nm ON nm.indicator = g.indicator AND nm.weight = g.weight AND nm.o = g.o AND nm.topic = x.topic GROUP BY ALL),
gd AS (SELECT indicator, weight, count(*) AS users, count(*) FILTER (s = 0) AS empty, round(avg(j), 6) AS jsd, round(stddev_samp(j), 6) AS sd FROM ng GROUP BY ALL)"""
GRID_CTES = (FE, CT, CM, BOTH, GR)
CF = "cf AS (SELECT count(*) FILTER (cls = 'ADDR') / count(*) AS addressed, count(*) FILTER (cls = 'SHARED') / count(*) AS shared, count(*) FILTER (event_type = 'view') / count(*) AS viewed FROM classified GROUP BY sender)"
Z1 = "z1 AS (SELECT u, week, variant, CASE WHEN arg_min(topic, -round(p, 12) * 1e6 + topic * 1e-7) = arg_min(topic, -round(g, 12) * 1e6 + topic * 1e-7) THEN 0.0 ELSE 1.0 END AS z FROM gs GROUP BY ALL)"


def subsets(means: str, nearest: str) -> str:
    return f"""ms AS ({means}), sb AS (SELECT DISTINCT list(y.id ORDER BY y.id) AS m FROM ms x JOIN ms y ON y.mean >= x.mean AND y.mean - x.mean < {nearest} GROUP BY x.id),
mx AS (SELECT m FROM sb WHERE NOT EXISTS (SELECT 1 FROM sb o WHERE len(o.m) > len(sb.m) AND list_has_all(o.m, sb.m)))"""


SUBSETS = "SELECT array_to_string(m, ',') AS subset, ms.id, ms.mean FROM (SELECT m, unnest(m) AS id FROM mx) x JOIN ms ON ms.id = x.id"
QUERIES = {
    "eligible_nodes": (eligible_nodes, sql("SELECT id, mask FROM en", IVX, EN)),
    "eligible_edges": (eligible_edges, sql("SELECT src, dst, CAST(sum(1 << i) AS BIGINT) AS mask FROM (SELECT sender AS src, other AS dst, center FROM classified JOIN iv ON ts > a AND ts <= b WHERE cls = 'ADDR' AND len = 7 AND sender % 5 <> 0 AND other IN (SELECT id FROM users WHERE is_core) GROUP BY ALL HAVING count(DISTINCT sign) = 2) JOIN ci ON c = center GROUP BY ALL", IVX)),
    "partition_slots": (partition_slots, sql("""SELECT id, mask, CAST(slot AS INTEGER) AS slot FROM (SELECT *, min(n) OVER () AS least FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY bit_count(mask), mask, id) AS k, count(*) OVER (PARTITION BY slot) AS n FROM
      (SELECT id, mask, b[1 + r // part] AS slot FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY mask) // len(b) AS part FROM (SELECT id, mask, list_filter([0, 1, 2], lambda i: (mask >> i) & 1 = 1) AS b FROM en)) WHERE r < part * len(b)))) WHERE k <= least""", IVX, EN)),
    "enough_observations": (enough_observations, sql("SELECT src, dst, steps FROM os WHERE steps > 2 AND steps / 5 > 0.7", WT, WS, OS)),
    "granger_counters": (granger_counters, sql("SELECT count(*) AS edges, count(*) FILTER (ok) AS kept, count(*) FILTER (steps = 0) AS without, round(avg(CASE WHEN ok THEN steps END), 6) AS mean, round(stddev_samp(CASE WHEN ok THEN steps END), 6) AS sd, max(steps) AS most FROM (SELECT steps, steps > 2 AND steps / 5 > 0.7 AS ok FROM os)", WT, WS, OS)),
    "influencer_fill": (influencer_fill, sql("SELECT u AS \"user\", strftime(week, '%Y-%m-%d') AS week, CASE WHEN lead(week) OVER w IS NULL THEN coalesce(lag(p) OVER w, p) ELSE p END AS p FROM (SELECT u, week, round(max(p), 6) AS p FROM th GROUP BY ALL) WINDOW w AS (PARTITION BY u ORDER BY week)", WT, TH)),
    "feature_assembly": (feature_assembly, sql("SELECT center, CAST(sign AS INTEGER) AS sign, role, source, CAST(topic AS INTEGER) AS topic, count(*) AS n, round(avg(p), 6) AS p FROM rf GROUP BY ALL", IVX, ROLES)),
    "feature_matrix": (feature_matrix, sql("""SELECT id, center, direction, 3 AS vars, round(sum(0.5 * (a * ln(a) + b * ln(b)) - (a + b) / 2 * ln((a + b) / 2)) FILTER (role = 'own') / ln(2), 6) AS change, round(max(CASE WHEN role = 'received' AND topic = 0 THEN a END), 6) AS first FROM (SELECT x.id, x.center, x.role, x.topic, CASE WHEN x.sign < 0 THEN 'forward' ELSE 'reversed' END AS direction, x.p AS a, y.p AS b
      FROM rf x JOIN rf y ON y.id = x.id AND y.center = x.center AND y.role = x.role AND y.topic = x.topic AND y.sign = -x.sign) GROUP BY ALL""", IVX, ROLES)),
    "neighborhood_sources": (neighborhood_sources, sql("SELECT o.origin, s.source, CAST(t.k AS INTEGER) AS topic, round(coalesce(sm.p, 0.2), 6) AS p FROM (SELECT DISTINCT src AS origin FROM explicit_edges) o CROSS JOIN (SELECT unnest(['incoming', 'outgoing', 'own', 'addressed']) AS source) s CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN sm ON sm.origin = o.origin AND sm.source = s.source AND sm.topic = t.k", IV, WK, FE, NS)),
    "baselines": (baselines, sql("""SELECT strftime(week, '%Y-%m-%d') AS week, variant, count(*) AS n, round(avg(j), 6) AS jsd FROM (SELECT u, week, variant, sum(0.5 * (p * ln(p) + g * ln(g)) - (p + g) / 2 * ln((p + g) / 2)) / ln(2) AS j FROM (SELECT th.u, th.week, th.topic, th.p, v.variant, CASE v.variant WHEN 'UNIFORM' THEN 0.2 WHEN 'PREVIOUS' THEN b.p WHEN 'CONST_COEFF' THEN (0.2 + b.p + a.g) / 3 ELSE (b.p + a.g) / 2 END AS g
      FROM th JOIN th b ON b.u = th.u AND b.topic = th.topic AND b.week = th.week - INTERVAL 7 DAY JOIN (SELECT week, topic, avg(p) AS g FROM th GROUP BY ALL) a ON a.week = b.week AND a.topic = b.topic CROSS JOIN (SELECT unnest(['UNIFORM', 'PREVIOUS', 'CONST_COEFF', 'EMPTY_NEIGHBORHOOD']) AS variant) v) GROUP BY ALL) GROUP BY ALL""", WT, TH)),
    "baseline_errors": (baseline_errors, sql("SELECT b.week, b.variant, b.jsd, b.cosine, z.z AS zero_one FROM bj b JOIN (SELECT strftime(week, '%Y-%m-%d') AS week, variant, round(avg(z), 6) AS z FROM z1 GROUP BY ALL) z ON z.week = b.week AND z.variant = b.variant", WT, TH, PD, Z1)),
    "anova_variants": (anova_variants, sql("""SELECT week, CASE WHEN variant = 'NEIGHBOURS' THEN 'SCIM' ELSE variant END AS variant, jsd FROM bj WHERE variant <> 'NEIGHBOURS' OR (NOT (SELECT o.out FROM ou o WHERE o.week = bj.week) AND (SELECT avg(CASE WHEN out THEN 1 ELSE 0 END) FROM ou) <= 0.5)""", WT, TH, PD,
      "ou AS (SELECT v.week, b.best * 2 <= v.jsd AS out FROM bj v JOIN (SELECT week, min(jsd) AS best FROM bj WHERE variant <> 'NEIGHBOURS' GROUP BY 1) b ON b.week = v.week WHERE v.variant = 'NEIGHBOURS')")),
    "neighborhood_grid": (neighborhood_grid, sql("SELECT indicator, weight, users, empty, jsd, sd FROM gd", *GRID_CTES)),
    "weight_missing": (weight_missing, sql("SELECT indicator AS name, round(avg(empty / users), 6) AS rate, round(coalesce(stddev_samp(empty / users), 0), 6) AS sd FROM gd GROUP BY 1 UNION ALL SELECT weight, round(avg(empty / users), 6), round(coalesce(stddev_samp(empty / users), 0), 6) FROM gd GROUP BY 1", *GRID_CTES)),
    "grid_survival": (grid_survival, sql("SELECT indicator AS name, round(count(*) FILTER (jsd <= mid) / 3, 6) AS rate FROM gd, (SELECT quantile_cont(jsd, 0.5) AS mid FROM gd) GROUP BY 1 UNION ALL SELECT weight, round(count(*) FILTER (jsd <= mid) / 2, 6) FROM gd, (SELECT quantile_cont(jsd, 0.5) AS mid FROM gd) GROUP BY 1", *GRID_CTES)),
    "best_subset": (best_subset, sql("SELECT indicator, weight, users, jsd FROM gd WHERE (indicator = 'EXPLICIT_DISTANCE_ONE' AND weight = 'CONSTANT') OR (indicator = 'COMMUNICATION_DISTANCE_ONE' AND weight = 'SHARED_RATIO')", *GRID_CTES)),
    "tree_json": (tree_json, sql("SELECT '{\"name\":\"' || indicator || '\",\"children\":[' || string_agg('{\"name\":\"' || weight || '\",\"value\":' || users || '}', ',' ORDER BY weight) || ']}' AS json FROM gd GROUP BY indicator", *GRID_CTES)),
    "coefficients": (coefficients, sql("""SELECT name, n, round(mean, 6) AS mean, round(var, 6) AS var, round(sqrt(var), 6) AS sd FROM (SELECT * FROM cs UNION ALL SELECT 'group ' || CASE WHEN name = 'viewed' THEN 'open' ELSE 'direct' END, max(n), sum(mean), sum(var) FROM cs WHERE name <> 'residual' GROUP BY 1)""", CF,
      "cs AS (SELECT name, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM (SELECT unnest(['addressed', 'shared', 'viewed', 'residual']) AS name, unnest([addressed, shared, viewed, 1 - (addressed + shared + viewed)]) AS x FROM cf) GROUP BY 1)")),
    "correlations": (correlations, sql("""SELECT variant, n, round(r, 6) AS r, round(1 - 2 * (SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + (i * t / 4000) ** 2 / (n - 2)) ** (-(n - 1) / 2.0)) * t / 12000 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) FROM (SELECT unnest(range(4001)) AS i)), 4) AS p
      FROM (SELECT variant, n, r, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT variant, count(*) AS n, corr(completeness, jsd) AS r FROM co JOIN (SELECT u, variant, avg(jsd) AS jsd FROM pd GROUP BY ALL) p ON p.u = co.id WHERE completeness >= 0 GROUP BY 1))""", CO, WT, TH, PD)),
    "training_errors": (training_errors, sql("SELECT variant, count(*) AS weeks, round(avg(m), 6) AS mean, round(sqrt(sum(sd * sd)) / count(*), 6) AS pooled FROM (SELECT variant, week, avg(jsd) AS m, stddev_samp(jsd) AS sd FROM pd GROUP BY ALL) GROUP BY 1", WT, TH, PD)),
    "marginal_means": (marginal_means, sql("SELECT week, max(jsd) FILTER (variant = 'UNIFORM') AS uniform, max(jsd) FILTER (variant = 'PREVIOUS') AS previous, max(jsd) FILTER (variant = 'NEIGHBOURS') AS neighbours FROM bj GROUP BY 1", WT, TH, PD)),
    "homogeneous": (homogeneous, sql(SUBSETS, WT, TH, PD, subsets("SELECT date_diff('day', DATE '2024-01-01', CAST(week AS DATE)) AS id, jsd AS mean FROM bj WHERE variant = 'PREVIOUS'", "0.02"))),
    "homogeneous_days": (homogeneous_days, sql(SUBSETS, subsets("SELECT day(ts) AS id, round(avg(value), 3) AS mean FROM events GROUP BY 1", "3.0"))),
    "entropy_by_interval": (entropy_by_interval, sql("""SELECT kind, center, CAST(len AS INTEGER) AS len, CAST(sign AS INTEGER) AS sign, count(*) AS n, round(avg(h), 6) AS entropy, round(count(*) / max(total), 6) AS active FROM (SELECT kind, a, b2, center, len, sign, -sum((c + 0.5) / (n + 2.5) * log2((c + 0.5) / (n + 2.5))) AS h FROM (SELECT g.*, t.k, coalesce(w.c, 0) AS c FROM
      (SELECT kind, a, b2, center, len, sign, sum(c) AS n FROM x GROUP BY ALL) g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN x w ON w.kind = g.kind AND w.a = g.a AND w.b2 = g.b2 AND w.center = g.center AND w.len = g.len AND w.sign = g.sign AND w.topic = t.k) GROUP BY ALL)
      JOIN (SELECT 'node' AS k2, count(*) AS total FROM users UNION ALL SELECT 'edge', count(*) FROM cm) ON k2 = kind GROUP BY ALL""", CM, IV, "x AS (SELECT CASE WHEN cls = 'ADDR' THEN 'edge' ELSE 'node' END AS kind, sender AS a, CASE WHEN cls = 'ADDR' THEN other ELSE -1 END AS b2, center, len, sign, topic, count(*) AS c FROM classified JOIN iv ON ts > iv.a AND ts <= iv.b WHERE cls <> 'SHARED' GROUP BY ALL)")),
    "missing_by_length": (missing_by_length, sql("SELECT CAST(len AS INTEGER) AS len, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd FROM (SELECT u.id, l.len, 1 - count(DISTINCT (x.center, x.sign)) FILTER (x.sender IS NOT NULL) / 6 AS r FROM users u CROSS JOIN (SELECT unnest([2, 5, 7]) AS len) l LEFT JOIN (SELECT DISTINCT sender, center, len, sign FROM classified JOIN iv ON ts > a AND ts <= b WHERE cls = 'NON_ADDR') x ON x.sender = u.id AND x.len = l.len GROUP BY ALL) GROUP BY 1", IV)),
    "indegree_stats": (indegree_stats, sql("SELECT net, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS sd FROM (SELECT n.net, u.id, count(e.src) AS k FROM users u CROSS JOIN (SELECT unnest(['explicit', 'purchase', 'comm']) AS net) n LEFT JOIN nets e ON e.dst = u.id AND e.net = n.net GROUP BY ALL) GROUP BY 1", CM, "nets AS (SELECT src, dst, 'explicit' AS net FROM explicit_edges UNION ALL SELECT src, dst, 'purchase' FROM purchase_edges UNION ALL SELECT src, dst, 'comm' FROM cm)")),
    "coverage": (coverage, sql("SELECT CASE WHEN real THEN 'explicit' ELSE 'complement' END AS network, count(*) AS edges, count(*) FILTER (similarity >= 0.05) AS found, round(count(*) FILTER (similarity >= 0.05) / count(*), 6) AS coverage, round(count(*) FILTER (active = 0) / count(*), 6) AS early_rate FROM s GROUP BY real", COMPLEMENT, WT, TH, CH,
      "alledges AS (SELECT src, dst, true AS real FROM explicit_edges UNION ALL SELECT src, dst, false FROM fake)", similar("p", "alledges").replace("s AS (SELECT e.src, e.dst,", "s AS (SELECT e.src, e.dst, e.real,"))),
    "network_evaluation": (network_evaluation, sql("SELECT round(p, 6) AS precision, round(s, 6) AS specificity, round((1 - s) * (neg - 1) / (1 / p - 1), 6) AS recall, round(bots / found, 6) AS bots FROM (SELECT count(*) FILTER (EXISTS (SELECT 1 FROM explicit_edges x WHERE x.src = e.src AND x.dst = e.dst)) / count(*) AS p, count(*) AS found, count(*) FILTER (src % 17 = 0) AS bots FROM purchase_edges e), (SELECT count(*) AS neg, 1 - count(*) FILTER (EXISTS (SELECT 1 FROM purchase_edges x WHERE x.src = f.src AND x.dst = f.dst)) / count(*) AS s FROM fake f)", COMPLEMENT)),
    "similarity_by_influencee": (similarity_by_influencee, sql("SELECT dst, count(*) AS n, round(avg(similarity), 6) AS mean, round(coalesce(stddev_samp(similarity), 0), 6) AS sd, round(max(similarity), 6) AS most FROM s GROUP BY 1", WT, TH, CH, similar("p"))),
    "best_step": (best_step, sql("SELECT src, dst, strftime(week, '%Y-%m-%d') AS week, g AS gain FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY g DESC, week DESC) AS k FROM (SELECT src, dst, week, round(mag * greatest(0, ln(2) - jsd), 6) AS g FROM j)) WHERE k = 1", WT, TH, CH, similar("p"))),
    "exposer_sets": (exposer_sets, sql("SELECT center, CAST(len AS INTEGER) AS len, CAST(sign AS INTEGER) AS sign, other AS \"user\", string_agg(CAST(sender AS VARCHAR), ',' ORDER BY sender) AS exposers FROM (SELECT DISTINCT center, len, sign, other, sender FROM classified JOIN iv ON ts > a AND ts <= b WHERE cls = 'ADDR') GROUP BY ALL", IV)),
    "chain_statistics": (chain_statistics, sql("SELECT count(*) AS chains, round(count(*) FILTER (root IN (SELECT child FROM lk WHERE parent IS NULL)) / count(*), 6) AS incomplete, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS sd, min(size) AS least, max(size) AS most, count(*) FILTER (size <= 10) AS short FROM (SELECT root, count(*) AS size FROM rt GROUP BY 1)", LK, RT, recursive=True)),
    "chain_histogram": (chain_histogram, sql("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM rt GROUP BY root) WHERE size <= 10 GROUP BY 1", LK, RT, recursive=True)),
    "distinct_models": (distinct_models, sql("SELECT DISTINCT round(count(*) FILTER (cls = 'ADDR') / count(*), 1) AS a, round(count(*) FILTER (cls = 'SHARED') / count(*), 1) AS b FROM classified GROUP BY sender")),
    "shuffled_sequences": (shuffled_sequences, sql("SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM classified WHERE cls = 'ADDR' WINDOW w AS (PARTITION BY sender, other ORDER BY md5('s' || id))")),
    "reindexed_sequences": (reindexed_sequences, sql("SELECT id, rank, lag(rank) OVER w AS prev, lead(rank) OVER w AS next FROM (SELECT *, row_number() OVER (ORDER BY sender, other, ts, id) - 1 AS rank FROM (SELECT *, count(*) OVER (PARTITION BY sender, other) AS n FROM classified WHERE cls = 'ADDR') WHERE n > 1) WINDOW w AS (PARTITION BY sender, other ORDER BY rank)")),
    "disjoint_recipients": (disjoint_recipients, sql("SELECT sender AS id, CAST(count(DISTINCT other) AS INTEGER) AS n FROM classified c WHERE cls = 'ADDR' AND sender IN (SELECT src FROM explicit_edges) GROUP BY 1 HAVING count(*) FILTER (EXISTS (SELECT 1 FROM explicit_edges e WHERE e.src = c.sender AND e.dst = c.other)) = 0")),
    "core_components": (core_components, sql("SELECT node, min(c) AS component FROM rc GROUP BY 1", "ce AS (SELECT src, dst FROM explicit_edges WHERE src % 7 = 0 AND dst % 7 = 0 AND dst IN (SELECT id FROM users)), cu AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce)", "rc(node, c) AS (SELECT DISTINCT src, src FROM cu UNION SELECT m.dst, rc.c FROM rc JOIN cu m ON m.src = rc.node)", recursive=True)),
}
