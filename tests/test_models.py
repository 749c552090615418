"""Fitted models' queries: what they are fitted on."""

import numpy as np
import regex
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.operators import models as M
from quern.operators import topics as P

D = "/root/testdata/sf0.001"


def test_lda_keeps_every_word(spark, monkeypatch):
    asked = {}

    def gibbs(docs, topics, terms, sweeps=P.SWEEPS, **more):
        asked.update(words=docs.select(F.sum(F.size("words"))).first()[0], last=docs.select(F.max(F.array_max("words"))).first()[0], terms=terms, sweeps=sweeps)
        return P.as_documents(docs).withColumn("z", F.transform("words", lambda w: w % topics)).withColumn("x", F.transform("words", lambda w: w * 0)), np.zeros((topics, terms))

    monkeypatch.setattr(P, "gibbs", gibbs)
    got = P.lda(spark, D).select("doc").distinct().count()
    rows = [(r.conv_id, [w for w in regex.split(r"[^\p{L}]+", (r.text or "").lower()) if len(w) > 1]) for r in spark.read.parquet(f"{D}/conversations.parquet").collect()]
    terms = len({w for _, ws in rows for w in ws})
    assert asked == {"words": sum(len(ws) for _, ws in rows), "last": terms - 1, "terms": terms, "sweeps": 2000}
    assert got == len({c for c, ws in rows if ws})


def two_topics(rng, n, share):
    """A document of words 0-4 (topic 0) and 5-9 (topic 1)."""
    return [int(rng.integers(0, 5)) + (0 if rng.random() < share else 5) for _ in range(n)]


def test_gibbs_finds_topics(spark):
    rng = np.random.default_rng(1)
    share = [float(rng.random() < 0.5) * 0.8 + 0.1 for _ in range(60)]
    docs = spark.createDataFrame([(i, two_topics(rng, 5 + i % 40, s)) for i, s in enumerate(share)], "doc long, words array<int>").repartition(3)
    state, counts = P.gibbs(docs, 2, 10, sweeps=120)
    assert state.count() == 60 and counts.sum() == sum(5 + i % 40 for i in range(60))
    phi = P.phi_of(counts)
    first = int(phi[0, :5].sum() > 0.5)  # which topic is the one of words 0-4
    assert phi[1 - first, :5].sum() > 0.95 and phi[first, 5:].sum() > 0.95 or phi[first, :5].sum() > 0.95
    low = 0 if phi[0, :5].sum() > 0.5 else 1
    got = {r.doc: r.theta[low] for r in P.theta_of(state, 2).collect()}
    assert np.mean([abs(got[i] - s) for i, s in enumerate(share) if i % 40 > 20]) < 0.12
    alpha = P.optimal_alpha(state, 2)
    assert (alpha > 0.05).all() and (alpha < 3).all() and P.optimal_alpha(state, 2, uniform=True).std() < 1e-12
    new = spark.createDataFrame([(i, two_topics(rng, 80, s)) for i, s in enumerate((0.9, 0.1, 0.5))], "doc long, words array<int>")
    asked = {r.doc: r.theta[low] for r in P.topic_query(new, phi, burn_in=40, samples=10, lag=3).collect()}
    assert asked[0] > 0.75 and asked[1] < 0.25 and 0.3 < asked[2] < 0.7
    prior = P.online_prior([np.zeros((2, 10)), counts], [0.2, 0.5])
    assert np.allclose(prior, 0.01 + 0.5 * counts)
    again = P.phi_of(P.gibbs(new, 2, 10, sweeps=20, beta=prior)[1], prior)
    assert np.abs(again - phi).max() < 0.1  # topics stay where the prior has them


def test_gibbs_stops_when_the_likelihood_stands(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [i % 2] * 20) for i in range(10)], "doc long, words array<int>")
    made = []
    monkeypatch.setattr(P, "log_likelihood", lambda c, b: made.append(1) or -100.0)
    P.gibbs(docs, 2, 2, sweeps=2000, local=1, tol=1e-4)
    assert len(made) == 10


def test_log_likelihood_of_topics():
    import math

    c = np.array([[3, 0, 1], [0, 2, 2]])
    want = 0.0  # words drawn one after the other
    for row in c:
        seen = np.zeros(3)
        for w, n in enumerate(row):
            for _ in range(n):
                want += math.log((seen[w] + 0.1) / (seen.sum() + 0.3))
                seen[w] += 1
    assert abs(P.log_likelihood(c, 0.1) - want) < 1e-9


def test_author_recipient_topics(spark):
    """An author writes of topic 0 to one recipient and of topic 1 to another; messages to both hold both."""
    rng = np.random.default_rng(2)
    rows = []
    for a in range(6):
        for i in range(40):
            rec = [[100], [200], [100, 200]][i % 3]
            words = sum((two_topics(rng, 6, 1.0 if r == 100 else 0.0) for r in rec), [])
            rows.append((a, i, words, rec))
    rows.append((7, 0, [], [100]))
    docs = P.as_authors(spark.createDataFrame(rows, "author long, pos long, words array<int>, recipients array<long>"))
    state, counts = P.gibbs(docs, 2, 10, sweeps=150, alpha=0.1)
    low = 0 if P.phi_of(counts)[0, :5].sum() > 0.5 else 1
    got = {(r.doc, r.other): r.theta[low] for r in P.theta_of(state, 2, 0.1).collect()}
    assert len(got) == 12 and all((p > 0.9) == (o == 100) and (p < 0.1) == (o == 200) for (_, o), p in got.items())


def test_social_states(spark):
    """Pairs whose messages go through a spell of one topic, then of another: a state for each, words shared by all pairs."""
    rng = np.random.default_rng(3)
    rows = [(p, [two_topics(rng, 8, 1.0 if i < 15 else 0.0) for i in range(30)]) for p in range(8)]
    state, counts = P.social_topics(spark.createDataFrame(rows, "pair long, words array<array<int>>"), 2, 2, 10, sweeps=40, alpha=0.1, local=10)
    phi = P.phi_of(counts)
    assert counts.sum() == 8 * 30 * 8 and {round(phi[0, :5].sum()), round(phi[1, :5].sum())} == {0, 1}
    spells = [r.s for r in state.collect()]
    split = [s for s in spells if len(set(s[:15])) == 1 and len(set(s[15:])) == 1 and s[0] != s[20]]
    assert len(split) >= 6
    out = P.social_results(state, 2, 2, 0.1).collect()
    assert len(out) == 16 and all(abs(sum(r.theta) - 1) < 1e-9 and abs(sum(r.moves) - 1) < 1e-9 for r in out)


def test_left_to_right_against_all_assignments():
    import itertools
    import math

    phi, alpha, words = np.array([[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]]), 0.5, [0, 2, 1, 0]
    total = 0.0
    for z in itertools.product((0, 1), repeat=4):
        p, n = 1.0, [0, 0]
        for i, (t, w) in enumerate(zip(z, words)):
            p *= (n[t] + alpha) / (i + 2 * alpha) * phi[t, w]
            n[t] += 1
        total += p
    for mode, most in (("NONE", 0.15), ("LOG", 0.1), ("ALL", 0.03)):  # the fewer are drawn again, the more it is off
        assert abs(P.left_to_right(words, phi, alpha, 20_000, np.random.default_rng(1), mode) - math.log(total)) < most


def test_dirichlet_multinomial_fixed_point():
    rng = np.random.default_rng(4)
    alpha = np.array([0.3, 1.0, 2.0])
    rows = [rng.multinomial(60, p) for p in rng.dirichlet(alpha, 4000)]
    counts, lengths = {}, {}
    for r in rows:
        for k, n in enumerate(r):
            counts[k, int(n)] = counts.get((k, int(n)), 0) + 1
        lengths[60] = lengths.get(60, 0) + 1
    got = K.dirichlet_fixed_point([(k, n, m) for (k, n), m in counts.items()], list(lengths.items()), 3, 1.0, False, 1000)
    assert np.allclose(got, alpha, rtol=0.1)


def test_hmm_selection_on_held_out_folds(spark):
    """Three states far apart: three is the best count on average, and no more rows than the grid's."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(24):
        s, x = 0, []
        for _ in range(60):
            s = s if rng.random() < 0.8 else int(rng.integers(0, 3))
            x.append(float(10 * s + rng.normal()))
        rows.append((i, x, i % 2 == 0))
    df = spark.createDataFrame(rows, "id long, x array<double>, complete boolean")
    got = M.hmm_selection(df, 4, 3, steps=15).collect()
    assert sorted((r.states, r.fold) for r in got) == [(n, k) for n in range(1, 5) for k in range(3)]
    mean = {n: np.mean([r.bic for r in got if r.states == n]) for n in range(1, 5)}
    assert all(np.isfinite(r.bic) for r in got) and min(mean, key=mean.get) == 3


def test_hmm_selection_in_tasks(spark, monkeypatch):
    """A table of one partition is not one task's work, and small tables' fits, each whole in a task, are those of passes over the sequences."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=i % 9) + 5 * (i % 2)], i % 3 == 0) for i in range(40)] + [(40, [float("nan")] * 3, True), (41, None, True)]
    cut, parts = M.cut, []

    def cutting(df):
        parts.append(len([1 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]))
        return cut(df)

    monkeypatch.setattr(M, "cut", cutting)
    odd = spark.createDataFrame(rows, "id long, x array<double>, complete boolean").coalesce(1)
    for df in (odd, odd.where("id < 40"), odd.where("id < 0"), odd.where("id = 5")):
        found = []
        for values in (10**6, 0):
            monkeypatch.setattr(M, "HMM_VALUES", values, raising=False)
            found.append({(r.states, r.fold): r.bic for r in M.hmm_selection(df, 3, 4, steps=6).collect()})
        a, b = found
        assert sorted(a) == sorted(b) == [(n, k) for n in range(1, 4) for k in range(4)]
        assert all(np.isclose(a[k], b[k], rtol=1e-9) for k in a)
        if df is not odd and df.count() > 1:
            assert all(np.isfinite(v) for v in a.values())
    assert parts[0] > 1


def test_hmm_starts_do_not_depend_on_partitions():
    """The smallest value whose share of the values is the cut or more, by hand; a fold that leaves nothing has no start."""
    row = lambda fold, *x: type("Row", (), {"fold": fold, "x": x})
    got = M.exact_starts([row(0, 4.0, 1.0), row(0, None, 3.0), row(1, 2.0)], 3, [0.5, 0.25, 0.75])
    assert got[0] == ([2.0] * 3, 0.0) and got[1][0] == [3.0, 1.0, 4.0] and got[2][0] == [2.0, 1.0, 3.0]
    assert M.exact_starts([row(0, 4.0)], 2, [0.5]) == {1: ([4.0], 0.0)}


def test_hmm_grid(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(M, "hmm_selection", lambda sequences, *grid: asked.append(grid))
    M.hmm_states(spark, D)
    assert asked == [(20, 10)]


def test_hmm_statistics_of_many_against_single_ones():
    rng = np.random.default_rng(6)
    models = [K.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.normal(size=3), rng.random(3) + 0.3) for _ in range(2)]
    seqs, complete = [rng.normal(size=n) for n in (5, 0, 9, 1, 4)], [True, True, False, True, False]
    weight = rng.integers(0, 2, (2, 5)).astype(float)
    got = K.hmm_statistics(models, seqs, complete, weight)
    for f, h in enumerate(models):
        assert np.allclose(got[f], sum(w * h.statistics(x, c) for w, x, c in zip(weight[f], seqs, complete) if len(x) and w))


def test_pair_sampler_in_plain_numbers():
    """counts follow every draw, and a pair costs its words, not array operations."""
    import time

    from quern.operators import topics as P

    rng = np.random.default_rng(31)
    words = [rng.integers(0, 38, 3) for _ in range(6)]
    s, z = rng.integers(0, 2, 6), [rng.integers(0, 4, 3) for _ in range(6)]
    kw = np.full((4, 38), 0.01)
    for w, t in zip(words, z):
        np.add.at(kw, (t, w), 1)
    lists, k = kw.tolist(), kw.sum(axis=1).tolist()
    begun = time.perf_counter()
    P.sample_pair(words, s, z, lists, k, 300, 2, 0.5, 0.5, np.random.default_rng(1))
    assert time.perf_counter() - begun < 0.5
    want = np.full((4, 38), 0.01)
    for w, t in zip(words, z):
        np.add.at(want, (t, w), 1)
    assert np.allclose(lists, want) and np.allclose(k, want.sum(axis=1)) and set(s.tolist()) <= {0, 1}


def test_lanes_run_along_memory():
    """F10, F14, F15, F16: a step reads its words, topics and candidates in a row; counts are those of the topics."""
    from quern.operators import topics as P

    rng = np.random.default_rng(32)
    rows = [(d, [7, 8, 9], rng.integers(0, 20, n).tolist(), [n - 1, 1], [[0, 2], [1]], [], []) for d, n in enumerate((5, 3, 9))]
    lanes = P.Lanes(rows, 4)
    assert lanes.words[:, 0].flags.c_contiguous and lanes.z[:, 0].flags.c_contiguous and lanes.may[:, 0, 0].flags.c_contiguous
    lanes.start(rng, 4)
    kw = np.full((4, 20), 0.01)
    np.add.at(kw, (lanes.z[lanes.lane, lanes.at], lanes.words[lanes.lane, lanes.at]), 1)
    for _ in range(5):
        lanes.sweep(rng, np.full(4, 0.5), lambda w: kw[:, w], lambda w, t, sign: np.add.at(kw, (t, w), sign))
    want, own = np.full((4, 20), 0.01), np.zeros_like(lanes.own)
    for i, (_, _, words, _, _, z, x) in enumerate(lanes.results()):
        assert set(x[:-1]) <= {0, 2} and x[-1] == 1
        np.add.at(want, (z, words), 1)
        np.add.at(own[i], (x, z), 1)
    assert np.allclose(kw, want) and np.array_equal(lanes.own, own)


def test_owner_counts_pass_words_once(spark):
    """owners' counts come from one pass over an author's words; owners without words have zeros."""
    state = spark.createDataFrame([(1, [5, 9, 7], [0, 1, 1, 2], [0, 0, 2, 0]), (2, [4], [], [])], "doc long, others array<long>, z array<int>, x array<int>")
    counts = P.owner_counts(state, 3)
    assert {(r.doc, r.other): r.counts for r in counts.collect()} == {(1, 5): [1, 1, 1], (1, 9): [0, 0, 0], (1, 7): [0, 1, 0], (2, 4): [0, 0, 0]}
    assert "MapInPandas" in counts._jdf.queryExecution().toString()
