"""Goldens, properties and SQL oracles of the engine's own operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import kernels as K
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import graphs as G


def edges(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


def sets(df):
    return {tuple(r.members) for r in df.collect()}


def test_tokenizer_goldens(spark):
    cases = [("123 abc abc 1 12 12.34 5,678", "abc abc"), ("#YourSong", "yoursong yoursong"), ("He said, she said.", "he said she said"), ("Mrs. v.s. i.e S.M.P 13:37", "mrs. v.s. i.e s.m.p 13:37"),
             ("RT @BillGates lol @SteveJobs blabla via @SteveBallmer", "lol blabla"), ("abc-def abc--def abc---def", "abc-def abc def abc def"), (":-) :) :P :p =D", ":-) :) :p :p =d"), ("", ""), (None, "")]
    got = spark.createDataFrame(cases, "t string, e string").select("e", F.array_join(T.tokens(F.col("t")), " ").alias("g")).collect()
    assert all(r.e == r.g for r in got)
    assert spark.createDataFrame([("https://t.co/AaAa",)], "t string").select(T.tokens(F.col("t"), keep_urls=True).alias("g")).first().g == ["http://t.co/AaAa"]


def test_formats(spark):
    r = spark.range(1).select(T.duration(F.lit(31536000 + 2 * 86400 + 3 * 3600 + 4 * 60 + 5.5)).alias("a"), T.duration(F.lit(0.5)).alias("b"), T.duration(F.lit(3700), 1).alias("c"),
        (T.interval_key(F.lit(86_400_000_000).cast("long"), F.lit(2)) == T.interval_key(F.lit(86_572_800_000).cast("long"), F.lit(-2))).alias("d")).first()
    assert tuple(r) == ("1y 2d 3h 4m 5s", "< 1s", "1h", True)


def test_change_goldens(spark):
    rows = [([1.0, 0, 0, 0, 0], [0.0, 0, 0, 0, 1], [0, 0, 0, 0, 1], 1), ([1.0, 0, 0, 0, 0], [1.0, 0, 0, 0, 0], [0.2] * 5, 0), ([1.0, 0, 0, 0, 0], [0.5, 0, 0, 0, 0.5], [0, 0, 0, 0, 1], 0.5), ([0.2] * 5, [1.0, 0, 0, 0, 0], [1, 0, 0, 0, 0], 1)]
    df = spark.createDataFrame([([float(x) for x in p], [float(x) for x in c]) for p, c, _, _ in rows], "p array<double>, c array<double>").select(V.change_direction("p", "c").alias("d"), V.change_magnitude("p", "c").alias("m"))
    for r, (_, _, d, m) in zip(df.collect(), rows):
        assert np.allclose(r.d, d) and abs(r.m - m) < 1e-12


def test_vectors(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5])], "a array<double>, b array<double>")
    r = df.select(V.jsd_2("a", "b").alias("j"), V.entropy("a").alias("h"), V.cosine("a", "b").alias("c"), V.zero_one("a", "b").alias("z"), V.smooth(F.array(F.lit(1), F.lit(0)), 0.5).alias("s"), V.log_sum_exp(F.array(F.lit(0.0), F.lit(0.0))).alias("l"), V.cumulative("a").alias("u")).first()
    assert abs(r.j - 0.5) < 1e-12 and abs(r.h - 1) < 1e-12 and abs(r.c - 0.5) < 1e-12 and r.z == 1.0 and np.allclose(r.s, [0.75, 0.25]) and abs(r.l - math.log(2)) < 1e-12 and np.allclose(r.u, [0.5, 1, 1])


def test_betweenness_golden(spark):
    names = {c: i for i, c in enumerate("ABCDEF")}
    pairs = [(names[a], names[b]) for a, b in ("AB", "AC", "AF", "BC", "FC", "CD", "FE", "ED", "BD")]
    got = {"ABCDEF"[r.id]: r.betweenness for r in G.betweenness(edges(spark, pairs + [(b, a) for a, b in pairs])).collect()}
    assert got == {"A": 1, "B": 1, "C": 3, "D": 3, "E": 1, "F": 3}


def test_clique_goldens(spark):
    assert sets(G.maximal_cliques(edges(spark, ["12", "13", "23", "34", "45", "46", "56"]))) == {(1, 2, 3), (3, 4), (4, 5, 6)}
    assert sets(G.maximal_cliques(edges(spark, ["13", "34", "32", "41", "42"]))) == {(1, 3, 4), (2, 3, 4)}
    assert sets(G.maximal_cliques(edges(spark, ["13", "34", "32", "41", "42", "12"]))) == {(1, 2, 3, 4)}


def plain_plexes(pairs, missing):
    """All maximal sets of three or more in which each lacks at most ``missing`` edges, by trying every set."""
    import itertools

    near = {}
    for a, b in pairs:
        near.setdefault(int(a), set()).add(int(b))
        near.setdefault(int(b), set()).add(int(a))
    ok = [set(c) for n in range(1, len(near) + 1) for c in itertools.combinations(sorted(near), n) if all(len(set(c) - near[v]) - 1 <= missing for v in c)]
    return {tuple(sorted(x)) for x in ok if len(x) >= 3 and not any(x < y for y in ok)}


def test_plex_goldens(spark):
    first, second = ["13", "23", "34", "45", "46"], ["13", "34", "32", "41"]
    assert plain_plexes(first, 1) >= {(1, 2, 3), (1, 3, 4), (2, 3, 4), (3, 4, 5), (3, 4, 6), (4, 5, 6)}
    assert sets(G.maximal_plexes(edges(spark, first))) == plain_plexes(first, 1)
    assert sets(G.maximal_plexes(edges(spark, second))) == plain_plexes(second, 1) == {(1, 2, 3), (1, 3, 4), (2, 3, 4)}
    assert sets(G.maximal_plexes(edges(spark, second), missing=2)) == plain_plexes(second, 2) == {(1, 2, 3, 4)}


def test_percolation_golden(spark):
    c = spark.createDataFrame([(x,) for x in ([0, 1, 2, 3], [1, 2, 3, 4], [5, 8, 9], [5, 6, 8], [6, 7, 8], [0, 5])], "members array<long>")
    found = {}
    for r in G.percolation(c).collect():
        found.setdefault(r.community, set()).add(r.v)
    assert sorted(map(sorted, found.values())) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    up = {v: v for p in pairs for v in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    linked = {v for a, b in pairs if a != b for v in (a, b)}
    assert {r.node: r.component for r in G.components(edges(spark, pairs)).collect()} == {v: top(v) for v in linked}


def test_pagerank_adds_up(spark):
    got = G.pagerank(edges(spark, [(0, 1), (1, 2), (2, 0), (3, 0)]), 5)
    assert abs(got.agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_benjamini_hochberg_golden():
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.324, 0.4262, 0.5719, 0.6528, 0.759, 1.0]
    assert K.benjamini_hochberg(np.array(p), 0.05) == [0, 1, 2, 3]


def test_hmm_divergence_golden():
    coin = lambda p: np.array([[p, 1 - p], [1 - p, p]])
    i = np.eye(2)
    for p, q in ((0.2, 0.5), (0.3, 0.9), (0.2, 0.2)):
        want = -0.5 * math.log2((p * q + (1 - p) * (1 - q)) / math.sqrt((p * p + (1 - p) ** 2) * (q * q + (1 - q) ** 2)))
        assert abs(K.hmm_divergence(coin(p), i, coin(q), i) - want) < 1e-6 and abs(K.hmm_divergence(coin(p), i, coin(q), i) - K.hmm_divergence(coin(q), i, coin(p), i)) < 1e-9
    assert abs(K.largest_eigenvalue(np.array([[2.0, 1], [1, 2]])) - 3) < 1e-9


def test_mds_keeps_order():
    d = np.array([[0, 93, 82, 133], [93, 0, 52, 60], [82, 52, 0, 111], [133, 60, 111, 0]], float)
    x, _ = K.mds(d)
    e = np.linalg.norm(x[:, None] - x[None], axis=2)
    iu = np.triu_indices(4, 1)
    assert (np.argsort(d[iu]) == np.argsort(e[iu])).all()


def test_special_functions():
    assert abs(K.inc_beta(2, 3, 0.4) - 0.5248) < 1e-9 and abs(K.inv_beta(2, 3, 0.5248) - 0.4) < 1e-9
    assert abs(K.inc_gamma(1, 2) - (1 - math.exp(-2))) < 1e-12
    assert len({tuple(K.kth_permutation(5, k)) for k in range(120)}) == 120


def test_lasso_finds_support():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    y = x[:, 1] * 2 - x[:, 5] * 3 + rng.normal(scale=0.1, size=200)
    b = K.sqrt_lasso(x, y, 0.1)
    assert set(np.flatnonzero(np.abs(b) > 0.2)) == {1, 5}
    _, _, p = K.debiased(x, y)
    assert set(np.flatnonzero(p < 1e-6)) == {1, 5}


def test_granger_direction():
    rng = np.random.default_rng(5)
    src = rng.normal(size=(200, 2))
    dst = np.vstack((np.zeros(2), src[:-1])) + rng.normal(scale=0.1, size=(200, 2))
    w, ok, _ = K.granger(dst, src)
    w2, back, _ = K.granger(src, dst)
    assert ok and not back and w > 0.9 > w2
    assert K.granger(np.zeros((10, 2)), np.zeros((10, 2)))[1] is False


def test_approximate_inverse_is_optimal():
    """Rows minimise m S m / 2 - m_i + mu |m|: no small move of a coordinate is better."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    cov, mu = x.T @ x / 60, 0.05
    m = K.approximate_inverse(cov, mu, fixed=True, eps=1e-9, most=2000)
    cost = lambda v, i: v @ cov @ v / 2 - v[i] + mu * np.abs(v).sum()
    for i in range(6):
        for j in range(6):
            for h in (1e-3, -1e-3):
                v = m[i].copy()
                v[j] += h
                assert cost(v, i) >= cost(m[i], i) - 1e-9
    free = K.approximate_inverse(cov, 0.5)
    assert np.abs(free @ cov - np.eye(6)).max() < 0.5


def test_drifting_targets_stay_in_the_simplex():
    rng = np.random.default_rng(9)
    for _ in range(200):
        c = rng.dirichlet(np.ones(4))
        far = rng.random() * 1.2 * (1 - c.min())
        x = K.at_distance(rng, np.full(4, 0.5), c, far)
        assert abs(x.sum() - 1) < 1e-9 and (x >= 0).all() and np.abs(x - c).sum() <= far + 1e-9
    p = rng.beta(2.0, 5.0, 20_000)
    assert np.allclose(K.fit_beta(p.mean(), p.var()), (2, 5), rtol=0.1) and K.fit_beta(1.0, 0.0) == (1.0, 1.0)


def test_kmeans_and_exemplars():
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(20, 2)) + c for c in ((0, 0), (20, 0), (0, 20))])
    own, exemplars, cost = K.kmeans(x, 3, rng)
    assert len({tuple(set(own[i : i + 20].tolist())) for i in (0, 20, 40)}) == 3 and sorted(e // 20 for e in exemplars) == [0, 1, 2] and cost < 300


def test_drift_and_networks(spark):
    """A target that always becomes what its source was meets it better than chance; an unrelated pair doesn't."""
    from datetime import datetime, timedelta

    from quern.operators import models as M

    rng = np.random.default_rng(11)
    weeks = [datetime(2024, 1, 1) + timedelta(days=7 * i) for i in range(24)]
    own = {u: rng.dirichlet(np.full(5, 0.3), 24) for u in (1, 3, 4)}
    own[2] = np.vstack((np.full((1, 5), 0.2), own[1][:-1]))
    rows = [(u, w, own[u][i].tolist()) for u in own for i, w in enumerate(weeks) if not (u == 4 and i == 5)]
    series = spark.createDataFrame(rows, "user long, week timestamp_ntz, theta array<double>")
    e = edges(spark, [(1, 2), (3, 4)])
    got = {(r.src, r.dst): r for r in M.drift_tests(e, series, weeks, samples=60).collect()}
    assert all(got[1, 2][f"p_{k}"] < 0.05 for k in M.DRIFTS) and got[1, 2].similarity > 0.5
    assert got[3, 4].p_unconstrained > 0.05
    p = spark.createDataFrame([(r.src, r.dst, 0.01 if r.src == 1 else 0.6, *[r[f"p_{k}"] for k in M.DRIFTS]) for r in got.values()], "src long, dst long, p double, p_unconstrained double, p_change double, p_direction double")
    found = {}
    for r in M.similarity_networks(p).collect():
        found.setdefault(r.model, set()).add((r.src, r.dst))
    assert found["main"] == found["permutation"] == found["change-corrected"] == {(1, 2)} and "direction" in found
    net = {(r.src, r.dst): r for r in M.granger_network(e, series).collect()}
    assert net[1, 2].significant and net[1, 2].nodewise and net[1, 2].weight > 0.5


def test_mixture_of_rows_against_the_kernel(spark):
    from quern.operators import models as M

    rng = np.random.default_rng(12)
    x = rng.dirichlet(np.ones(4), (80, 3))
    y = 0.6 * x[:, 0] + 0.4 * x[:, 2]
    c, free, _ = M.fit_mixture(spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<array<double>>, y array<double>").repartition(3), steps=80)
    assert abs(c[0] - 0.6) < 0.06 and abs(c[2] - 0.4) < 0.06 and c[1] + free.sum() < 0.1


def plain_reach(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    out = {}
    for v in near:
        seen, stack = {v}, [v]
        while stack:
            for t in near[stack.pop()] - seen:
                seen.add(t)
                stack.append(t)
        out[v] = seen
    return out


def test_strong_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(24)]
    pairs = [p for p in pairs if p[0] != p[1]]
    reach = plain_reach(pairs)
    want = {v: min(t for t in reach[v] if v in reach[t]) for v in reach}
    assert {r.node: r.component for r in G.strong_components(edges(spark, pairs)).collect()} == want


def test_linkage_levels(spark):
    rng = random.Random(8)
    pairs = [(a, b, round(rng.random(), 1)) for a in range(9) for b in range(a) if rng.random() < 0.5]
    df = spark.createDataFrame([(a, b, d) for a, b, d in pairs], "src long, dst long, distance double")
    got = {r.height: r.clusters for r in G.linkage_levels(df, 9).collect()}
    assert None in got and len(got) > 1
    for h, n in got.items():
        up = list(range(9))
        for a, b, d in pairs:
            if h is None or d < h:
                up = [up[a] if x == up[b] else x for x in up]
        assert n == len(set(up))


def test_exact_ranks(spark):
    from quern.operators.tables import ranked

    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(400)] + [(None, 1), (5, 5)] * 3, "a long, b long").repartition(5)
    got = sorted((r["rank"], r.a, r.b) for r in ranked(df, "a", "b").collect())
    rows = [(a, b) for _, a, b in got]
    assert [r for r, _, _ in got] == list(range(406)) and rows == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_chains_that_never_end(spark):
    from quern.operators.windows import roots

    link = lambda *p: spark.createDataFrame([(a, b) for a, b in p], "child long, parent long")
    got = {r.node: (r.root, r.depth) for r in roots(link(*[(i + 1, i) for i in range(20)], (50, 3), (60, None))).collect()}
    assert got == {i: (0, i) for i in range(21)} | {50: (0, 4), 60: (60, 0)}


def test_complement_fills_up_or_refuses(spark):
    from quern.operators.theta import complement_edges

    v = spark.createDataFrame([(i,) for i in range(6)], "id long")
    e = edges(spark, [(a, b) for a in range(6) for b in range(6) if a != b and (a, b) not in ((0, 1), (4, 2), (5, 0))])
    assert {tuple(r) for r in complement_edges(v, e, 3).collect()} == {(0, 1), (4, 2), (5, 0)}
    with pytest.raises(ValueError):
        complement_edges(v, e, 4)


def test_homogeneous_subsets_are_cliques(spark):
    from quern.operators.evaluation import homogeneous_subsets

    m = spark.createDataFrame([(1, 0.0), (2, 0.8), (3, 1.5), (4, 9.0)], "id long, mean double")
    assert {r.subset for r in homogeneous_subsets(m, 1.0).collect()} == {"1,2", "2,3", "4"}


def test_jdbc(spark, tmp_path):
    """An embedded database, where the distribution has one."""
    from quern.sources import files

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no embedded database")
    df = spark.range(40).select(F.col("id"), (F.col("id") * 2).alias("v"))
    files.write_jdbc(df, url, "numbers", batch=7)
    got = files.read_jdbc(spark, url, "numbers", "id", 0, 40, 3, fetch=5)
    assert got.rdd.getNumPartitions() == 3 and sorted((r[0], r[1]) for r in got.collect()) == [(i, 2 * i) for i in range(40)]


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    from types import SimpleNamespace

    from quern.operators.tables import folder

    other = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        folder(other, "x")


def test_hmm_recovers_means():
    rng = np.random.default_rng(2)
    seqs = [(np.where(np.repeat(rng.random(20) < 0.5, 5), 0.0, 8.0) + rng.normal(size=100), True) for _ in range(10)]
    h, ll = K.fit_hmm(seqs, 2)
    assert np.allclose(sorted(h.mean), [0, 8], atol=0.4) and ll > -10_000
    assert [round(x) for x in K.bursts(np.array([[0.5, 0.5], [0.2, 0.8]]), np.array([1.0, 5.0]))[0]] == [1, 2, 2]


def test_simplex_mixture():
    rng = np.random.default_rng(3)
    th = rng.dirichlet(np.ones(4), size=(50, 3))
    c, free = K.simplex_mixture(th, 0.7 * th[:, 0] + 0.3 * th[:, 2])
    assert abs(c[0] - 0.7) < 0.05 and abs(c[2] - 0.3) < 0.05 and free.sum() < 0.05


def test_settings(tmp_path):
    (tmp_path / "s").write_text("# c\nusers = 10\nA.users = 20\nflag=true\nlens = 2,5\n")
    s = Settings.read(str(tmp_path / "s"))
    assert s.int("users") == 10 and s.of("A").int("users") == 20 and s.bool("flag") and s.ints("lens") == [2, 5]
    with pytest.raises(KeyError):
        s.get("missing")


def test_files(spark, tmp_path):
    from quern.sources import files

    e = edges(spark, [(1, 2), (2, 3)]).withColumn("weight", F.lit(0.5))
    files.write_graphml(e, str(tmp_path / "g"))
    assert sorted(map(tuple, files.read_graphml(spark, str(tmp_path / "g")).collect())) == [(1, 2, 0.5), (2, 3, 0.5)]
    files.write_ncol(e, str(tmp_path / "n"))
    assert sorted(map(tuple, files.read_ncol(spark, str(tmp_path / "n")).collect())) == [(1, 2), (2, 3)]
    c = spark.createDataFrame([([1, 2, 3],)], "members array<long>")
    files.write_cliques(c, str(tmp_path / "c"))
    assert files.read_cliques(spark, str(tmp_path / "c")).first().members == [1, 2, 3]
    line = spark.range(1).select(files.encode_sequence(F.lit(False), F.array(F.lit(1.5), F.lit(2.0))).alias("s"))
    assert line.first().s == "-1;1.5;2"
    complete, deltas = files.decode_sequence(F.col("s"))
    assert tuple(line.select(complete, deltas).first()) == (False, [1.5, 2.0])


def test_stream_equals_batch(spark, tmp_path):
    from quern.streaming import slices

    d = "/root/testdata/sf0.001"
    src = tmp_path / "events"
    events = spark.read.parquet(f"{d}/events.parquet")
    events.repartition(2).write.parquet(str(src))
    got = slices.run_once(slices.weekly_counts(slices.read_events(spark, str(src))), "weekly", str(tmp_path / "cp"))
    want = slices.weekly_counts(events)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


def test_permutations_of_edges_side_by_side(spark):
    """an edge's permutations are one array and bounds are found once; the p of a permutation at a time stays."""
    import math
    import time

    from quern.functions import kernels as K

    rng = np.random.default_rng(21)
    series = lambda: (lambda c: (c + 0.5) / (c + 0.5).sum(axis=2, keepdims=True))(rng.integers(0, 3, (400, 5, 4)).astype(float))
    s, t = series(), series()
    begun = time.perf_counter()
    scores = K.permuted_scores(s, t)
    got = [K.permutation_p(x, np.random.default_rng(i), 100, 50) for i, x in enumerate(scores)]
    assert time.perf_counter() - begun < 8  # 16 s before, a permutation at a time
    for i in range(5):
        up = np.maximum(t[i, 1:] - t[i, :-1], 0)
        tot, low = up.sum(axis=1), t[i, :-1].min(axis=1)
        score = lambda x: sum(w / (1 - lo) * max(0.0, math.log(2) - K.jsd(a, u / w if w > 0 else np.full(4, 0.25))) for w, lo, a, u in zip(tot, low, x, up))  # noqa: B023, E731
        assert got[i] == K.monte_carlo(score(s[i, :-1]), lambda g: score(s[i][g.permutation(5)][:-1]), np.random.default_rng(i), 100, 50)[0]  # noqa: B023


def test_drift_of_many_sources_into_one_target(spark):
    """all sources of a target meet its samples as one array; values are those of a pair at a time."""
    from datetime import datetime, timedelta

    from quern.functions import kernels as K
    from quern.operators import models as M

    rng = np.random.default_rng(22)
    weeks = [datetime(2024, 1, 1) + timedelta(days=7 * i) for i in range(5)]
    own = {u: rng.dirichlet(np.ones(5), 5) for u in range(41)}
    missing = {(3, 1), (3, 2), (3, 3), (3, 4), (3, 0), (4, 2), (0, 3)}
    rows = [(u, w, own[u][i].tolist()) for u in own for i, w in enumerate(weeks) if (u, i) not in missing]
    series = spark.createDataFrame([*rows, (3, datetime(2023, 1, 2), [0.2] * 5)], "user long, week timestamp_ntz, theta array<double>")
    e = edges(spark, [(u, 0) for u in range(1, 41)])
    calls, one = [], K.lagged_similarities
    got = {r.src: r for r in M.drift_tests(e, series, weeks, samples=20).collect()}
    assert len(got) == 40 and got[3].similarity is None and got[3].p_change == 1
    for (u, i) in missing:
        own[u][i] = np.nan
    for u in (1, 2, 4, 40):
        assert got[u].similarity == K.lagged_similarity(own[u], own[0], own[0], 1)
        calls.append(one(own[u][None], own[0], own[0][None], 1)[0, 0] == got[u].similarity)
        assert all(0 < got[u][f"p_{k}"] <= 1 for k in M.DRIFTS)
    assert all(calls)


def test_similarity_models_spread_over_tasks(spark):
    """both tests run in as many tasks as the cores ask for, whatever their few bytes."""
    from datetime import datetime

    from quern.operators import models as M

    e = edges(spark, ["12", "13"])
    series = spark.createDataFrame([(u, datetime(2024, 1, 1 + 7 * i), [0.5, 0.5]) for u in (1, 2, 3) for i in range(3)], "user long, week timestamp_ntz, theta array<double>")
    n = M.tasks(e)
    assert n >= 4 * spark.sparkContext.defaultParallelism
    assert M.aligned(e, series).rdd.getNumPartitions() == n
    assert M.permutation_test(e, series).rdd.getNumPartitions() == n


def test_two_steps_are_counted_without_pairs(spark):
    """number, sum and own membership by sets of bits and lists, in blocks and parts, against the pairs."""
    rng = np.random.default_rng(23)
    e = edges(spark, sorted({(int(a), int(b) if a % 3 else int(b) % 4) for a, b in rng.integers(0, 300, (1500, 2))} | {(i, 301) for i in range(0, 300, 7)} | {(301, i) for i in range(300)}))
    want = {}
    for s, t in G.two_hop(e, e).collect():
        want.setdefault(s, set()).add(t)
    held, G.HELD_EDGES = G.HELD_EDGES, 400
    try:
        got = {r.src: (r.n, r.ids, r.own) for r in G.reach(e, e).collect()}
    finally:
        G.HELD_EDGES = held
    assert got == {s: (len(x), sum(x), int(s in x)) for s, x in want.items()}
    assert "own" in G.reach(e.where("false"), e).columns and not G.reach(e.where("false"), e).count() and G.reach(e, e.where("false")).count() == len(want)


def test_shared_targets_by_blocks(spark):
    """pairs of sources are counted in tiles, by products of matrices or one by one, and only those with enough are rows."""
    from quern.functions import kernels as K
    rng = np.random.default_rng(24)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (700, 2))} | {(i, 99) for i in range(60)})
    to = {}
    for s, t in rows:
        to.setdefault(s, set()).add(t)
    want = {(a, b): len(to[a] & to[b]) for a in to for b in to if a < b and len(to[a] & to[b]) >= 3}
    for blocks in (150, 10_000):
        held, G.HELD_EDGES = G.HELD_EDGES, blocks
        try:
            got = [tuple(r) for r in G.shared(edges(spark, rows), 3).collect()]
        finally:
            G.HELD_EDGES = held
        assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    ids, lists = np.array(sorted(to)), [np.array(sorted(to[s])) for s in sorted(to)]
    for cells, dense in ((40, 10**9), (10**6, 1), (700, 64)):
        old, K.PAIR_CELLS, K.DENSE = (K.PAIR_CELLS, K.DENSE), cells, dense
        try:
            got = {(int(a), int(b)): int(n) for x in K.shared_counts(ids, lists, ids, lists, 3) for a, b, n in zip(*x) if a < b}
        finally:
            K.PAIR_CELLS, K.DENSE = old
        assert got == want


def test_communities_around_a_hub(spark):
    """a vertex of many cliques makes no pairs of them; cliques meet by the sets of k - 1 vertices that they share."""
    n = 400
    e = edges(spark, [(0, i) for i in range(1, n + 1)] + [(i, i + 1) for i in range(1, n) if i % 100])
    c = G.maximal_cliques(e, 3)
    assert sorted(tuple(r.members) for r in c.collect()) == [(0, i, i + 1) for i in range(1, n) if i % 100]
    found = {}
    for k, v in G.percolated_members(c).collect():
        found.setdefault(k, set()).add(v)
    assert sorted(map(sorted, found.values())) == [[0, *range(a, a + 100)] for a in (1, 101, 201, 301)]
    four = edges(spark, ["12", "13", "14", "23", "24", "34", "15", "25", "35", "67", "68", "78", "16"])
    assert sets(G.percolation(G.maximal_cliques(four, 3), 4).groupBy("community").agg(F.sort_array(F.collect_list("v")).alias("members"))) == {(1, 2, 3, 4, 5)}
