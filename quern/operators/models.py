"""Fitted models: hidden Markov models, Granger networks, permutation tests, mixtures.

Grouped work runs in grouped-map kernels seeded by the group's key; iterative fits exchange only small sufficient
statistics (state sums) between steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.functions import vectors as V
from quern.operators.messages import classified, epoch
from quern.operators.tables import cut, drop, tasks
from quern.operators.theta import change_series, weekly_theta
from quern.operators.windows import inter_event
from quern.sources import social
from quern.sources.social import sql


def seed(*parts: object) -> np.random.Generator:
    import zlib

    return np.random.default_rng(zlib.crc32(repr(parts).encode()))


# Hidden Markov models -----------------------------------------------------------------------------------------------------


def fit_hmm(sequences: DataFrame, states: int, steps: int = 20, tol: float = 1e-4) -> tuple[K.Hmm, float]:
    """(model, log-likelihood) of ``sequences`` (x array<double>, complete boolean): each step adds up one row per partition."""
    first = sequences.select(F.explode("x").alias("v")).agg(F.percentile_approx("v", [(i + 0.5) / states for i in range(states)], 1000), F.var_pop("v")).first()
    h = K.Hmm(np.full(states, 1 / states), np.full((states, states), 1 / states), np.array(first[0]) + np.arange(states) * 1e-6, np.full(states, max((first[1] or 0) / states, 1e-3)))
    last = -np.inf
    size = 2 + states + states * states + 3 * states
    for _ in range(steps):

        def run(batches: Iterator[pd.DataFrame], h=h) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for b in batches:
                total += K.hmm_statistics([h], [np.array(x, float) for x in b["x"]], list(b["complete"]), np.ones((1, len(b))))[0]
            yield pd.DataFrame({"k": range(size), "v": total})

        rows = sequences.select("x", "complete").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect()  # `size` rows
        s = np.zeros(size)
        for k, v in rows:
            s[k] = v
        if s[0] < last or s[0] - last < tol:
            break
        h, last = h.updated(s), s[0]
    return h, float(last)


#: Most values of all sequences that are sent to every task, which then fits its state counts whole.
HMM_VALUES = 500_000


def next_fits(now: dict, last: dict, sums: dict, tol: float) -> tuple[dict, list]:
    """(fits that go on, by key; keys of degenerate ones) after a step with statistics ``sums`` of the fits ``now``; ``last`` gets their likelihoods."""
    going, lost = {}, []
    for key, s in sums.items():
        if not np.isfinite(s).all():
            lost.append(key)
        elif key not in last or s[0] - last[key] >= tol:
            going[key] = now[key].updated(s)
            last[key] = s[0]
    return going, lost


def exact_starts(held: list, folds: int, cuts: list[float]) -> dict:
    """(values at ``cuts``, as percentile_approx takes them, and variance) of all folds but one, for each fold."""
    found = {}
    for k in range(folds):
        v = np.sort([x for r in held if r.fold != k for x in r.x if x is not None])
        if len(v):
            found[k] = ([float(v[max(int(np.ceil(c * len(v))) - 1, 0)]) for c in cuts], float(v.var()))
    return found


def hmm_selection(sequences: DataFrame, most: int = 20, folds: int = 10, steps: int = 100, tol: float = 0.1) -> DataFrame:
    """states, fold, bic: every state count is fitted on all folds but one and judged on that one, for each fold.

    Up to HMM_VALUES values, a task holds all sequences and takes all steps of a state count's fits. Beyond, a step is one pass
    over the sequences for all fits that still go on; only their statistics are added up. A fold
    without sequences, one that leaves none to fit on, and a degenerate fit have an infinite bic.
    """
    spark = sequences.sparkSession
    # A small table in one file would be one task's work.
    data = cut(sequences.where(F.size("x") > 0).select(F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold"), "x", "complete").repartition(spark.sparkContext.defaultParallelism))
    grid = [(n, k) for n in range(1, most + 1) for k in range(folds)]
    cuts = [(i + 0.5) / n for n in range(1, most + 1) for i in range(n)]
    held = data.collect() if (data.agg(F.sum(F.size("x"))).first()[0] or 0) <= HMM_VALUES else None
    if held is not None:
        begun = exact_starts(held, folds, cuts)
    else:
        values = data.select("fold", F.explode("x").alias("v")).withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))))
        begun = {k: (q, v) for k, q, v in values.groupBy("k").agg(F.percentile_approx("v", cuts, 10_000), F.var_pop("v")).collect()}  # a row per fold
    models = {}
    for n, k in grid:
        if k in begun:
            q, v = begun[k]
            models[n, k] = K.Hmm(np.full(n, 1 / n), np.full((n, n), 1 / n), np.array(q[n * (n - 1) // 2 : n * (n + 1) // 2]) + np.arange(n) * 1e-6, np.full(n, max((v or 0) / n, 1e-3)))

    def statistics(now: dict, xs: list, complete: list, fold: np.ndarray) -> dict:
        found = {}
        for n in {n for n, _ in now}:
            own = [k for m, k in now if m == n]
            weight = np.array([fold != k for k in own], float)
            found |= zip([(n, k) for k in own], K.hmm_statistics([now[n, k] for k in own], xs, complete, weight))
        return found

    def together(held: list) -> None:
        xs, complete, fold = [np.array(r.x, float) for r in held], [r.complete for r in held], np.array([r.fold for r in held])

        def fit(batches: Iterator[pd.DataFrame], begin=models) -> Iterator[pd.DataFrame]:
            for n in [most - i for b in batches for i in b["id"]]:
                active, last = {key: h for key, h in begin.items() if key[0] == n}, {}
                ended = dict(active)
                for _ in range(steps):
                    if not active:
                        break
                    active, lost = next_fits(active, last, statistics(active, xs, complete, fold), tol)
                    ended |= active
                    for key in lost:
                        del ended[key]
                parts = [(h.start, h.move.ravel(), h.mean, h.var) for h in ended.values()]
                yield pd.DataFrame({"n": n, "k": [k for _, k in ended], "h": pd.Series([np.concatenate(p) for p in parts], dtype=object)})

        # A task for each state count, the largest first.
        got = spark.range(0, most, 1, most).mapInPandas(fit, "n int, k int, h array<double>").collect()  # a row per fit
        models.clear()
        for n, k, h in got:
            start, move, mean, var = np.split(np.array(h, float), [n, n + n * n, 2 * n + n * n])
            models[n, k] = K.Hmm(start, move.reshape(n, n), mean, var)

    def apart() -> None:
        active, last = dict(models), {}

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for b in batches:
                for n, k, s in zip(b["n"], b["k"], b["s"]):
                    total[n, k] = total.get((n, k), 0) + np.array(s, float)  # not a number comes as null
            yield pd.DataFrame({"n": [n for n, _ in total], "k": [k for _, k in total], "s": pd.Series(list(total.values()), dtype=object)})

        for _ in range(steps):

            def run(batches: Iterator[pd.DataFrame], now=active) -> Iterator[pd.DataFrame]:
                total: dict = {}
                for b in batches:
                    for key, s in statistics(now, [np.array(x, float) for x in b["x"]], list(b["complete"]), np.array(b["fold"])).items():
                        total[key] = total.get(key, 0) + s
                yield pd.DataFrame({"n": [n for n, _ in total], "k": [k for _, k in total], "s": pd.Series(list(total.values()), dtype=object)})

            if not active:
                break
            parts = data.mapInPandas(run, "n int, k int, s array<double>")
            sums = {(n, k): np.zeros(2 + 4 * n + n * n) for n, k in active}
            for n, k, s in parts.repartition("n", "k").mapInPandas(add, parts.schema).collect():  # a row per fit, sizes by parameters
                sums[n, k] = np.array(s, float)
            active, lost = next_fits(active, last, sums, tol)
            models.update(active)
            for key in lost:
                del models[key]

    if held is not None:
        together(held)
    else:
        apart()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for b in batches:
            xs, fold = [np.array(x, float) for x in b["x"]], np.array(b["fold"])
            for n in {n for n, _ in models}:
                own = [k for m, k in models if m == n]
                weight = np.array([fold == k for k in own], float)
                got = K.hmm_statistics([models[n, k] for k in own], xs, list(b["complete"]), weight)
                rows += [(n, k, s[0], int(sum(len(x) for x, f in zip(xs, fold) if f == k))) for k, s in zip(own, got) if (fold == k).any()]
        found = pd.DataFrame(rows, columns=["n", "k", "ll", "size"])
        yield found.groupby(["n", "k"], as_index=False).sum()

    judged = data.mapInPandas(judge, "n int, k int, ll double, size long").groupBy("n", "k").agg(F.sum("ll"), F.sum("size")).collect()  # a row per fit
    bic = {(n, k): -2 * ll + (n * n + 2 * n - 1) * np.log(size) for n, k, ll, size in judged if np.isfinite(ll)}
    drop(data)
    return spark.createDataFrame([(n, k, float(bic.get((n, k), np.inf))) for n, k in grid], "states int, fold int, bic double")


def user_sequences(spark, d: str) -> DataFrame:
    """Logs of the seconds between a user's messages."""
    w = Window.partitionBy("sender").orderBy("ts", "id")
    m = classified(spark, d).withColumn("delta", (epoch(F.col("ts")) - F.lag(epoch(F.col("ts"))).over(w)) / 1e6).where("delta > 0")
    return m.groupBy(F.col("sender").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", F.ln("delta").alias("x")))), lambda s: s["x"]).alias("x")).withColumn("complete", F.col("id") % 2 == 0)


# Networks of causes ------------------------------------------------------------------------------------------------------------------


def aligned(edges: DataFrame, series: DataFrame) -> DataFrame:
    """src, dst, and both series on the weeks that both have, in order."""
    s = series.select(F.col("user").alias("src"), "week", F.col("theta").alias("_s"))
    t = series.select(F.col("user").alias("dst"), "week", F.col("theta").alias("_t"))
    both = edges.join(s, "src").join(t, ["dst", "week"])
    rows = F.sort_array(F.collect_list(F.struct("week", "_s", "_t")))
    both = both.repartition(tasks(edges), "src", "dst")
    return both.groupBy("src", "dst").agg(rows.alias("r")).select("src", "dst", F.transform("r", lambda x: x["_s"]).alias("s"), F.transform("r", lambda x: x["_t"]).alias("t"))


def granger_network(edges: DataFrame, series: DataFrame, alpha: float = 0.05, least: int = 4) -> DataFrame:
    """src, dst, weight, significant, corrected, nodewise: a sparse vector autoregression per edge, in parallel over edges.

    ``significant`` holds an edge's scores against its own false-discovery threshold at ``alpha``, ``corrected`` at alpha over the
    number of edges into dst, ``nodewise`` against the threshold of the scores of all edges into dst, which meet in one group:
    a few numbers an edge, not series.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [K.granger_scores(np.array([list(x) for x in t]), np.array([list(x) for x in s])) for s, t in zip(b["s"], b["t"])]
            cell = lambda k: pd.Series([g[k].tolist() for g in got], dtype=object, index=b.index)
            yield pd.DataFrame({"src": b["src"], "dst": b["dst"], "weight": [float(g[0]) for g in got], "own": cell(1), "every": cell(2)})

    def judge(key, pdf):
        pooled = np.concatenate([np.array(v, float) for v in pdf["own"]])
        level = K.jj_threshold(pooled, alpha) if len(pooled) else np.inf
        top = np.array([max(v, default=-np.inf) for v in pdf["own"]])
        reach = lambda a: np.array([len(o) > 0 and max(o) >= K.jj_threshold(np.array(e), a) for o, e in zip(pdf["own"], pdf["every"])], bool)
        return pd.DataFrame({"src": pdf["src"], "dst": pdf["dst"], "weight": pdf["weight"], "significant": reach(alpha), "corrected": reach(alpha / len(pdf)), "nodewise": top >= level})

    scored = aligned(edges, series).where(F.size("s") >= least).mapInPandas(run, "src long, dst long, weight double, own array<double>, every array<double>")
    return scored.groupBy("dst").applyInPandas(judge, "src long, dst long, weight double, significant boolean, corrected boolean, nodewise boolean")


def full_series(edges: DataFrame, series: DataFrame, weeks: list) -> DataFrame:
    """src, dst, s, t: both series over all ``weeks``, null where a user is missing."""
    m = series.groupBy("user").agg(F.map_from_entries(F.collect_list(F.struct("week", "theta"))).alias("m"))
    m = m.select("user", F.array(*[F.try_element_at("m", F.lit(w)) for w in weeks]).alias("v"))
    return edges.join(m.select(F.col("user").alias("src"), F.col("v").alias("s")), "src").join(m.select(F.col("user").alias("dst"), F.col("v").alias("t")), "dst").select("src", "dst", "s", "t")


DRIFTS = ("unconstrained", "change", "direction")


def drift_tests(edges: DataFrame, series: DataFrame, weeks: list, prior: float = 0.5, samples: int = 200) -> DataFrame:
    """src, dst, similarity, p_unconstrained, p_change, p_direction: how often a target that drifts by chance meets the source better.

    A synthetic target is drawn from the prior (unconstrained), or moves from its last value by a magnitude drawn from the Beta
    distribution of all magnitudes (change), or by its own (direction). It depends on the target and the sample's number
    only, so all edges into a target share it wherever they are tested.
    """
    c = change_series(series).where("direction IS NOT NULL").select("magnitude")
    m = c.agg(F.avg("magnitude").alias("m"), F.var_pop("magnitude").alias("v")).first()
    beta = K.fit_beta(m.m or 0.0, m.v or 0.0)

    width = len((series.first() or {"theta": ()})["theta"])

    def array(v):
        return np.array([[np.nan] * width if x is None else list(x) for x in v], float)

    def synthetic(kind: str, dst: int, t: np.ndarray, i: int) -> np.ndarray:
        rng, a, out = seed("drift", kind, dst, i), np.full(t.shape[1], prior), np.full_like(t, np.nan)
        for j in range(1, len(t)):
            if np.isnan(t[j, 0]):
                continue
            if kind == "unconstrained" or np.isnan(t[j - 1, 0]):
                out[j] = rng.dirichlet(a)
                continue
            room = 1 - min(t[j - 1].min(), 1)
            magnitude = rng.beta(*beta) if kind == "change" else np.maximum(t[j] - t[j - 1], 0).sum() / max(room, 1e-300)
            out[j] = K.at_distance(rng, a, t[j - 1], 2 * magnitude * room)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, made = None, {}
        for b in batches:
            out = []
            for dst, rows in b.groupby("dst", sort=False):
                if dst != held:
                    held, made = dst, {}
                t = array(rows["t"].iloc[0])
                s = np.stack([array(x) for x in rows["s"]])
                now = K.lagged_similarities(s, t, t[None], 1)[:, 0]
                p, known = np.ones((len(s), len(DRIFTS))), ~np.isnan(now)
                for i, kind in enumerate(DRIFTS):
                    if known.any():
                        if kind not in made:
                            made[kind] = np.stack([synthetic(kind, int(dst), t, j) for j in range(samples)])
                        p[known, i] = (1 + (K.lagged_similarities(s[known], t, made[kind], 1) > now[known, None]).sum(axis=1)) / (1 + samples)
                out.append(pd.DataFrame({"src": rows["src"].to_numpy(), "dst": dst, "similarity": pd.Series(now, dtype=object).where(known, None)} | {f"p_{k}": p[:, i] for i, k in enumerate(DRIFTS)}))
            if out:
                yield pd.concat(out)

    # Balanced ranges: a target's samples are drawn once a range that holds it, and no target is one task's work.
    full = full_series(edges, series, weeks).repartitionByRange(tasks(edges), "dst", "src").sortWithinPartitions("dst")
    return full.mapInPandas(run, "src long, dst long, similarity double, p_unconstrained double, p_change double, p_direction double")


def hochberg(p: DataFrame, name: str, alpha: float = 0.05) -> DataFrame:
    """The edges (src, dst) of ``p`` whose column ``name`` passes Benjamini-Hochberg among the edges into the same dst."""
    w = Window.partitionBy("dst").orderBy(name, "src")
    r = p.withColumn("i", F.row_number().over(w)).join(p.groupBy("dst").agg(F.count("*").alias("n")), "dst")
    last = r.where(F.col(name) <= F.col("i") / F.col("n") * alpha).groupBy("dst").agg(F.max("i").alias("k"))
    return r.join(last, "dst").where("i <= k").select("src", "dst")


def similarity_networks(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """model, src, dst of the sub-models of tests with columns p (of permutations) and those of ``drift_tests``: each test alone, with
    permutations uncorrected, and corrected by target; ``main`` is corrected permutations with the corrected unconstrained drift."""
    perm = p.where(F.col("p") < alpha).select("src", "dst")
    perm_bh = hochberg(p, "p", alpha)
    out = perm.withColumn("model", F.lit("permutation"))
    for k in DRIFTS:
        alone = p.where(F.col(f"p_{k}") < alpha).select("src", "dst")
        both = perm_bh.join(hochberg(p, f"p_{k}", alpha), ["src", "dst"], "left_semi")
        out = out.unionByName(alone.withColumn("model", F.lit(k))).unionByName(alone.join(perm, ["src", "dst"], "left_semi").withColumn("model", F.lit(f"{k}-uncorrected")))
        out = out.unionByName(both.withColumn("model", F.lit("main" if k == "unconstrained" else f"{k}-corrected")))
    return out.select("model", "src", "dst")


def fit_mixture(rows: DataFrame, ridge: float = 1e-4, steps: int = 60, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights of the n features, free vector, mean loss) of the mixture nearest to the targets; rows: x array<array<double>>, y.

    Weights and vector are one point of the simplex, found by exponentiated gradient; a step adds up one gradient a partition, so
    any number of rows takes part.
    """
    data = cut(rows.select("x", "y"))
    n, k = data.select(F.size("x"), F.size("y")).first()

    def loss(c: np.ndarray) -> tuple[float, np.ndarray, int]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(n + k + 2)
            for b in batches:
                if len(b):
                    x, y = np.array([[list(v) for v in r] for r in b["x"]]), np.array([list(r) for r in b["y"]])
                    s = np.maximum(np.einsum("n,rnk->rk", c[:n], x) + c[n:], 1e-300)
                    norm = np.linalg.norm(s, axis=1, keepdims=True)
                    g = np.log(2) - np.log(s + y) + np.log(s) + ridge * s / norm
                    total += np.concatenate((np.einsum("rk,rnk->n", g, x), g.sum(axis=0), [((np.log(2) - np.log(s + y)) * (s + y) + s * np.log(s)).sum() + ridge * norm.sum(), len(b)]))
            yield pd.DataFrame({"i": range(n + k + 2), "v": total})

        got = np.zeros(n + k + 2)
        for i, v in data.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():  # n + k + 2 rows
            got[i] = v
        return got[-2] / got[-1], got[:-2] / got[-1], int(got[-1])

    c, rate = np.full(n + k, 1 / (n + k)), 2.0
    now, grad, _ = loss(c)
    for _ in range(steps):
        new = c * np.exp(-rate * (grad - grad.min()))
        new /= new.sum()
        got, g, _ = loss(new)
        if got <= now:
            done, c, now, grad, rate = now - got < tol, new, got, g, rate * 1.5
            if done:
                break
        else:
            rate /= 3
    drop(data)
    return c[:n], c[n:], now


def permutation_test(edges: DataFrame, series: DataFrame, samples: int = 100) -> DataFrame:
    """src, dst, p: how often a permuted source meets the change at least as well; seeded by the edge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ps = np.ones(len(b))
            sizes = b["s"].map(len).to_numpy()
            for n in np.unique(sizes):  # edges of as many weeks side by side
                at = np.flatnonzero(sizes == n)
                s, t = (np.array([[list(v) for v in b[c].iloc[i]] for i in at], float) for c in ("s", "t"))
                for i, scores in zip(at, K.permuted_scores(s, t)):
                    ps[i] = K.permutation_p(scores, seed("perm", int(b["src"].iloc[i]), int(b["dst"].iloc[i])), samples, 50)
            yield pd.DataFrame({"src": b["src"], "dst": b["dst"], "p": ps})

    return aligned(edges, series).where(F.size("s") >= 3).mapInPandas(run, "src long, dst long, p double")


# Queries ----------------------------------------------------------------------------------------------------------


def word_counts(spark, d):
    t = social.table(spark, d, "conversations").select("conv_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("length(term) > 1")
    return t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


def hmm_fit(spark, d):
    h, ll = fit_hmm(cut(user_sequences(spark, d)), 2, 20_000, 1e-6)
    order = np.argsort(h.mean)
    return spark.createDataFrame([(int(k), float(h.mean[i]), float(h.var[i]), ll) for k, i in enumerate(order)], "state int, mean double, var double, ll double")


def hmm_states(spark, d):
    return hmm_selection(user_sequences(spark, d), 20, 10)


def granger(spark, d):
    return granger_network(social.explicit_edges(spark, d), weekly_theta(spark, d))


def permutation(spark, d):
    return permutation_test(social.explicit_edges(spark, d), weekly_theta(spark, d))


ROLES = ("own", "addressed", "exposure", "received", "incoming", "outgoing", "neighbours", "neighbours_addressed", "all", "all_addressed")


def node_vectors(spark, d, center: str, length: int = 7) -> DataFrame:
    """id, k, theta: the ten distributions of a core user before the date, in the order of ROLES; those that a user lacks are left out."""
    from quern.operators.neighbourhood import WEIGHTS, features, weighted_mean
    from quern.operators.theta import intervals, sliced, theta

    m = cut(sliced(classified(spark, d), intervals(spark, centers=(center,), lengths=(length,)).where("sign < 0")))
    a, o, prior = m.where("cls = 'ADDR'"), m.where("cls = 'NON_ADDR'"), [0.2] * 5
    own, sent, got = theta(o, "sender").withColumnRenamed("sender", "id"), theta(a, "sender").withColumnRenamed("sender", "id"), theta(a, "other").withColumnRenamed("other", "id")
    e = social.explicit_edges(spark, d).where("src <> dst")
    near = cut(e.select(F.col("src").alias("origin"), F.col("dst").alias("candidate")).join(features(spark, d).select("candidate", "n_in"), "candidate"))
    seen = theta(a.select("sender", F.col("other").alias("id")).distinct().join(o.select("sender", "topic"), "sender"), "id")  # what those who write to a user post
    pair = theta(a, "sender", "other")
    w = WEIGHTS["NUM_INCOMING_1P"]()
    of = lambda v: weighted_mean(near, v.select(F.col("id").alias("candidate"), F.col("theta").alias("c_theta")), w, prior).withColumnRenamed("origin", "id")
    both = near.withColumn("candidate", F.struct("origin", "candidate"))
    along = lambda x, y: weighted_mean(both, pair.select(F.struct(F.col(x).alias("origin"), F.col(y).alias("candidate")).alias("candidate"), F.col("theta").alias("c_theta")), w, prior).withColumnRenamed("origin", "id")
    ids = social.users(spark, d).where("is_core").select("id")
    one = lambda x: ids.crossJoin(F.broadcast(theta(x.withColumn("_all", F.lit(1)), "_all").select("theta")))  # noqa: E731  # one row
    parts = (own, sent, seen, got, along("other", "sender"), along("sender", "other"), of(own), of(sent), one(o), one(a))
    out = None
    for k, p in enumerate(parts):
        x = p.select("id", F.lit(k).alias("k"), "theta")
        out = x if out is None else out.unionByName(x)
    return out.join(ids, "id", "left_semi")


def mixture_model(spark, d):
    """Weights of the ten sources of a user's next week at 2024-01-22, fitted on users of even id, and the errors on the others."""
    from quern.operators.theta import intervals, sliced, theta

    f = node_vectors(spark, d, "2024-01-22").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "theta"))).alias("m"))
    prior = F.array(*[F.lit(0.2)] * 5)
    x = f.select("id", F.array(*[F.coalesce(F.try_element_at("m", F.lit(k)), prior) for k in range(len(ROLES))]).alias("x"))
    after = sliced(classified(spark, d).where("cls = 'NON_ADDR'"), intervals(spark, centers=("2024-01-22",), lengths=(7,)).where("sign > 0"))
    rows = cut(x.join(theta(after, "sender").select(F.col("sender").alias("id"), F.col("theta").alias("y")), "id"))
    c, free, _ = fit_mixture(rows.where("id % 2 = 0"))
    guess = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda t: sum(float(w) * F.get(F.get(F.col("x"), F.lit(i)), t) for i, w in enumerate(c)) + F.get(F.array(*[F.lit(float(v)) for v in free]), t))
    jsd = rows.where("id % 2 = 1").agg(F.avg(V.jsd_2("y", guess))).first()[0]
    weights = [*zip(ROLES, map(float, c)), ("free", float(free.sum())), ("test error", float(jsd) if jsd is not None else None)]
    return spark.createDataFrame(weights, "name string, value double")


def series_weeks(spark, d) -> tuple[DataFrame, list]:
    t = cut(weekly_theta(spark, d))
    return t, [r.week for r in t.select("week").distinct().orderBy("week").collect()]  # one row a week


def drift(spark, d):
    t, weeks = series_weeks(spark, d)
    return drift_tests(social.explicit_edges(spark, d), t, weeks)


def similarity_models(spark, d):
    """Edges of each sub-model of similarity with its tests."""
    t, weeks = series_weeks(spark, d)
    e = social.explicit_edges(spark, d)
    return similarity_networks(cut(drift_tests(e, t, weeks, samples=100).join(permutation_test(e, t), ["src", "dst"]))).groupBy("model").agg(F.count("*").alias("edges"))


def hmm_embedding(spark, d):
    """Models of the pace of users who address, view and share most, laid out in the plane by the distances of their transitions, in two to
    three clusters: the cluster of each, and the exemplars."""
    w = Window.partitionBy("sender").orderBy("ts", "id")
    m = classified(spark, d).withColumn("x", F.ln(((epoch(F.col("ts")) - F.lag(epoch(F.col("ts"))).over(w)) / 1e6))).where("x IS NOT NULL").withColumn("kind", F.concat_ws("-", "event_type", F.col("topic").cast("string")))
    seqs = m.groupBy("kind", "sender").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "x"))), lambda s: s["x"]).alias("x")).withColumn("complete", F.lit(True))

    def fit(key, pdf):
        h, ll = K.fit_hmm([(np.array(x, float), True) for x in pdf["x"]], 2, 30)
        at = np.argsort(h.mean)
        return pd.DataFrame({"kind": [key[0]], "move": pd.Series([h.move[np.ix_(at, at)].ravel().tolist()], dtype=object)})

    models = seqs.groupBy("kind").applyInPandas(fit, "kind string, move array<double>").orderBy("kind").collect()  # a row per kind
    moves = [np.array(r.move).reshape(2, 2) for r in models]
    dist = np.array([[np.mean([np.sqrt(max(K.jsd(a[i], b[i]) / np.log(2), 0)) for i in range(2)]) for b in moves] for a in moves])
    x, _ = K.mds(dist)
    out = []
    for k in (2, 3):
        own, exemplars, _ = K.kmeans(x, k, seed("embedding", k))
        out += [(k, r.kind, int(own[i]), i in exemplars) for i, r in enumerate(models)]
    return spark.createDataFrame(out, "clusters int, kind string, cluster int, exemplar boolean")


def dist_fit(spark, d):
    """Moments and log-likelihoods of normal, log-normal and exponential models of the gaps between messages."""
    x = inter_event(spark, d).where("delta > 0").select("delta", F.ln("delta").alias("l"))
    s = x.agg(F.count("*").alias("n"), F.avg("delta").alias("m"), F.stddev_samp("delta").alias("sd"), F.avg("l").alias("lm"), F.stddev_samp("l").alias("ls"), F.sum("l").alias("sl"))
    c = np.log(2 * np.pi) / 2
    ll_n = -F.col("n") * (c + F.ln("sd")) - (F.col("n") - 1) / 2.0
    ll_l = -F.col("n") * (c + F.ln("ls")) - (F.col("n") - 1) / 2.0 - F.col("sl")
    ll_e = -F.col("n") * (F.ln("m") + 1)
    return s.select("n", F.round("m", 3).alias("mean"), F.round("lm", 6).alias("log_mean"), F.round(ll_n / F.col("n"), 6).alias("normal"), F.round(ll_l / F.col("n"), 6).alias("lognormal"), F.round(ll_e / F.col("n"), 6).alias("exponential"))


def kde(spark, d):
    """Density of log10 gaps at 41 points, Gaussian kernel, h = 1.06 min(sd, IQR / 1.34) n^-0.2, within 5 h."""
    x = inter_event(spark, d).where("delta > 0").select(F.round(F.log10("delta"), 6).alias("l"))
    s = x.agg(F.count("*").alias("n"), F.stddev_samp("l").alias("sd"), F.percentile("l", F.lit(0.75)).alias("q3"), F.percentile("l", F.lit(0.25)).alias("q1"))
    s = s.select("n", (1.06 * F.least("sd", (F.col("q3") - F.col("q1")) / 1.34) * F.pow("n", F.lit(-0.2))).alias("h"))
    # Values of one rounding are one row with a weight; each meets the 41 points only.
    v = x.groupBy("l").agg(F.count("*").alias("w")).crossJoin(F.broadcast(s))
    p = v.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: i / 5.0))).where("abs(x - l) <= 5 * h")
    return p.groupBy("x").agg(F.round(F.sum(F.col("w") * F.exp(-0.5 * F.pow((F.col("x") - F.col("l")) / F.col("h"), 2)) / (F.col("h") * F.col("n") * np.sqrt(2 * np.pi))), 6).alias("density"))


def ll_plugin(spark, d):
    """Log-likelihood of event types under sender distributions and topic-type probabilities: sum over events of ln sum_k."""
    from quern.operators.theta import theta

    m = classified(spark, d)
    th = theta(m, "sender").select("sender", F.posexplode("theta").alias("topic", "p"))
    c = m.groupBy("topic", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("topic")
    ph = c.select("topic", "event_type", ((F.col("n") + 0.01) / (F.sum("n").over(w) + 0.01 * F.count("*").over(w))).alias("phi"))
    n = m.groupBy("sender", "event_type").agg(F.count("*").alias("n"))
    j = n.join(th, "sender").join(ph, ["topic", "event_type"]).groupBy("sender", "event_type").agg(F.first("n").alias("n"), F.sum(F.col("p") * F.col("phi")).alias("s"))
    return j.groupBy("sender").agg(F.round(F.sum(F.col("n") * F.ln("s")), 6).alias("ll"))


GAPS = "gp AS (SELECT round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sender ORDER BY ts, id)) / 1e6, 3) AS delta FROM messages)"
QUERIES = {
    "word_counts": (word_counts, "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM conversations) WHERE length(term) > 1 GROUP BY 1 ORDER BY n DESC, term LIMIT 50"),
    "dist_fit": (dist_fit, sql("""SELECT n, round(m, 3) AS mean, round(lm, 6) AS log_mean, round((-n * (ln(2 * pi()) / 2 + ln(sd)) - (n - 1) / 2.0) / n, 6) AS normal, round((-n * (ln(2 * pi()) / 2 + ln(ls)) - (n - 1) / 2.0 - sl) / n, 6) AS lognormal, round(-(ln(m) + 1), 6) AS exponential
      FROM (SELECT count(*) AS n, avg(delta) AS m, stddev_samp(delta) AS sd, avg(ln(delta)) AS lm, stddev_samp(ln(delta)) AS ls, sum(ln(delta)) AS sl FROM gp WHERE delta > 0)""", GAPS)),
    "kde": (kde, sql("""SELECT x, round(sum(exp(-0.5 * ((x - l) / h) ** 2)) / (max(h) * max(n) * sqrt(2 * pi())), 6) AS density FROM (SELECT unnest(range(41)) / 5.0 AS x), (SELECT round(log10(delta), 6) AS l FROM gp WHERE delta > 0),
      (SELECT count(*) AS n, 1.06 * least(stddev_samp(l), (quantile_cont(l, 0.75) - quantile_cont(l, 0.25)) / 1.34) * count(*) ** -0.2 AS h FROM (SELECT round(log10(delta), 6) AS l FROM gp WHERE delta > 0)) WHERE abs(x - l) <= 5 * h GROUP BY x""", GAPS)),
    "ll_plugin": (ll_plugin, sql("""SELECT sender, round(sum(n * ln(s)), 6) AS ll FROM (SELECT n.sender, n.event_type, max(n.n) AS n, sum(th.p * ph.phi) AS s FROM (SELECT sender, event_type, count(*) AS n FROM messages GROUP BY ALL) n
      JOIN (SELECT g.sender, t.k AS topic, (coalesce(w.n, 0) + 0.5) / (g.n + 2.5) AS p FROM (SELECT sender, count(*) AS n FROM messages GROUP BY 1) g CROSS JOIN (SELECT unnest(range(5)) AS k) t LEFT JOIN (SELECT sender, topic, count(*) AS n FROM messages GROUP BY ALL) w ON w.sender = g.sender AND w.topic = t.k) th ON th.sender = n.sender
      JOIN (SELECT topic, event_type, (n + 0.01) / (sum(n) OVER v + 0.01 * count(*) OVER v) AS phi FROM (SELECT topic, event_type, count(*) AS n FROM messages GROUP BY ALL) WINDOW v AS (PARTITION BY topic)) ph ON ph.topic = th.topic AND ph.event_type = n.event_type GROUP BY 1, 2) GROUP BY 1""")),
    "hmm_fit": (hmm_fit, None),
    "hmm_states": (hmm_states, None),
    "granger": (granger, None),
    "permutation": (permutation, None),
    "mixture_model": (mixture_model, None),
    "drift": (drift, None),
    "similarity_models": (similarity_models, None),
    "hmm_embedding": (hmm_embedding, None),
}
