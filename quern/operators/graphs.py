"""Graph operators on edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.operators.messages import ADDR, classified
from quern.operators.tables import cut, drop, tasks
from quern.sources import social
from quern.sources.social import sql

#: Adjacency that kernels hold whole (betweenness, cliques of few vertices): most edges that may be sent to tasks.
LOCAL_EDGES = 5_000_000


def reverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(e: DataFrame) -> DataFrame:
    """a < b, each pair once, no loops."""
    return e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def mutual_edges(e: DataFrame) -> DataFrame:
    return e.join(reverse(e), ["src", "dst"], "left_semi")


def induced(e: DataFrame, vertices: DataFrame) -> DataFrame:
    v = vertices.select(F.col("id").alias("src"))
    return e.join(v, "src", "left_semi").join(v.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs at distance one or two: one step along ``first``, perhaps one more along ``second``. May hold loops."""
    f, s = first.alias("f"), second.alias("s")
    return first.select("src", "dst").union(f.join(s, F.col("f.dst") == F.col("s.src")).select(F.col("f.src"), F.col("s.dst"))).distinct()


#: Most edges of one side that a task holds of a product of graphs.
HELD_EDGES = 1_000_000


def lists(e: DataFrame, *keys: str) -> DataFrame:
    return e.groupBy(*keys, "src").agg(F.collect_list("dst").alias("to"))


def reach(first: DataFrame, second: DataFrame) -> DataFrame:
    """src, n, ids, own: how many vertices ``two_hop`` pairs src with, their sum, and whether src is among them, without its pairs.

    A task meets a block of sources with the second step's edges into a part of the vertices; sets over many edges are bits. Memory
    goes with the edges of both, whose number is bounded, pairs are never rows. Edges are sent once for each block or part.
    """
    first, second = cut(first.select("src", "dst").distinct()), cut(second.select("src", "dst").distinct())
    parts = -(-second.count() // HELD_EDGES) or 1
    blocks = max(-(-first.count() // HELD_EDGES), -(-tasks(first) // parts))
    of = lambda v, n: F.pmod(F.xxhash64(v), F.lit(n)).cast("int")
    f = lists(first).withColumn("block", of("src", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    f = f.select("block", "part", "src", "to", F.filter("to", lambda v: of(v, parts) == F.col("part")).alias("near"))
    s = lists(second.withColumn("part", of("dst", parts)), "part").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", "src", "to")

    def run(f, s):
        import pandas as pd

        got = K.reached(f["src"].to_numpy(), list(f["to"]), list(f["near"]), s["src"].to_numpy(), list(s["to"]))
        return pd.DataFrame(dict(zip(("src", "n", "ids", "own"), (f["src"], *got))))

    n = blocks * parts
    keyed = lambda x: x.repartition(n, "block", "part").groupBy("block", "part")
    got = keyed(f).cogroup(keyed(s)).applyInPandas(run, "src long, n long, ids long, own int")
    return got.groupBy("src").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.max("own").alias("own"))


def shared(e: DataFrame, least: int) -> DataFrame:
    """a < b, n: sources with at least ``least`` targets in common. Blocks of sources meet in pairs; a task counts one pair of blocks in tiles
    and gives only the pairs that have enough, so that no pair is sent or stored before it is counted."""
    e = cut(e.select("src", "dst").distinct())
    blocks = max(-(-e.count() // HELD_EDGES), 1)
    while blocks * (blocks + 1) // 2 < tasks(e):
        blocks += 1
    rows = lists(e).withColumn("block", F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select((i * blocks + j).alias("pair"), (F.col("block") == j).alias("right"), (i == j).alias("same"), "src", "to")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def count(held: list) -> Iterator:
            g = pd.concat(held)
            same = bool(g["same"].iloc[0])
            x, y = (g, g) if same else (g[~g["right"]], g[g["right"]])
            for a, b, n in K.shared_counts(x["src"].to_numpy(), list(x["to"]), y["src"].to_numpy(), list(y["to"]), least):
                keep = a < b if same else slice(None)
                yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "n": n[keep]})

        held, pair = [], None
        for b in batches:
            for key, g in b.groupby("pair", sort=False):
                if held and key != pair:
                    yield from count(held)
                    held = []
                pair = key
                held.append(g)
        if held:
            yield from count(held)

    n = blocks * (blocks + 1) // 2
    return rows.repartition(n, "pair").sortWithinPartitions("pair").mapInPandas(run, "a long, b long, n long")


def components(e: DataFrame) -> DataFrame:
    """node, component (its smallest node) by alternating stars: rounds grow with the log of the longest path."""
    cur = cut(undirected(e).select(F.col("b").alias("u"), F.col("a").alias("v")))
    seen = None
    while (sign := cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()) != seen:
        seen = sign
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        last, cur = cur, cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        drop(last)
        drop(large)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """The edges (src, dst, distance) of a minimum spanning forest, by Boruvka's rounds: every component takes its nearest edge out,
    ties by the edge itself; rounds grow with the log of the vertices."""
    e = cut(pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "distance").groupBy("src", "dst").agg(F.min("distance").alias("distance")))
    names = cut(e.select(F.col("src").alias("v")).union(e.select("dst")).distinct().withColumn("c", F.col("v")))
    forest = None
    while True:
        x = e.join(names.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(names.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst").where("cs <> cd")
        out = F.struct("distance", "src", "dst", "cs", "cd").alias("x")
        near = x.select(F.col("cs").alias("c"), out).union(x.select(F.col("cd").alias("c"), out)).groupBy("c").agg(F.min("x").alias("x"))
        taken = cut(near.select("x.*").distinct())
        if not taken.limit(1).count():
            return forest if forest is not None else taken.select("src", "dst", "distance")
        forest = taken.select("src", "dst", "distance") if forest is None else forest.union(taken.select("src", "dst", "distance"))
        merged = components(taken.select(F.col("cs").alias("src"), F.col("cd").alias("dst")))
        names = cut(names.join(merged, names["c"] == merged["node"], "left").select("v", F.coalesce("component", "c").alias("c")))


def linkage_levels(pairs: DataFrame, vertices: int) -> DataFrame:
    """height, clusters: how many clusters single linkage of ``vertices`` points has strictly below each distinct height, and (height
    null) after the last merge."""
    per = spanning_forest(pairs).groupBy("distance").agg(F.count("*").alias("n"))  # one row per distinct height
    w = Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    below = per.select(F.col("distance").alias("height"), (F.lit(vertices) - F.coalesce(F.sum("n").over(w), F.lit(0))).cast("long").alias("clusters"))
    return below.union(per.agg(F.lit(None).cast("double"), (F.lit(vertices) - F.coalesce(F.sum("n"), F.lit(0))).cast("long")))


def strong_components(e: DataFrame) -> DataFrame:
    """node, component (its smallest node). Every node takes the least id that reaches it as its colour; the nodes of a colour that
    reach that id are a component and leave; the rest go on. Rounds inside grow with the longest shortest path."""
    e = cut(e.where("src <> dst").distinct())
    v = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    done = None
    while True:
        colour = cut(v.withColumn("c", F.col("node")))
        while True:
            got = e.join(colour, e["src"] == colour["node"]).groupBy("dst").agg(F.min("c").alias("m"))
            nxt = cut(colour.join(got, colour["node"] == got["dst"], "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("new")))
            colour = nxt.select("node", "c")
            if not nxt.where("new").limit(1).count():
                break
        x, y = colour.withColumnRenamed("node", "src"), colour.withColumnRenamed("node", "dst").withColumnRenamed("c", "cd")
        inside = cut(e.join(x, "src").join(y, "dst").where("c = cd").select("src", "dst"))
        back = cut(colour.where("node = c"))
        while True:
            more = inside.join(back.select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c").distinct().join(back, "node", "left_anti")
            more = cut(more)
            if not more.limit(1).count():
                break
            back = cut(back.union(more))
        found = back.select("node", F.col("c").alias("component"))
        done = found if done is None else done.union(found)
        v = cut(v.join(back, "node", "left_anti"))
        if not v.limit(1).count():
            return done
        e = cut(e.join(v.select(F.col("node").alias("src")), "src", "left_semi").join(v.select(F.col("node").alias("dst")), "dst", "left_semi"))


def pagerank(e: DataFrame, iterations: int = 10, jump: float = 0.2, every: int = 5) -> DataFrame:
    """id, rank after a fixed number of iterations; ranks add up to 1 and dangling mass is spread evenly."""
    e = e.distinct()
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    n = v.count()
    out = e.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("src")))
    r = v.withColumn("rank", F.lit(1.0 / n))
    for k in range(iterations):
        flow = out.join(r, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        lost = r.join(out.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        r = v.join(flow, F.col("id") == F.col("dst"), "left").crossJoin(F.broadcast(lost)).select("id", (jump / n + (1 - jump) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (k + 1) % every == 0:
            r = cut(r)
    return r


def adjacency(e: DataFrame) -> dict[int, list[int]]:
    """Out-neighbours by vertex, for kernels that walk the whole graph; the size is checked before it is collected."""
    n = e.count()
    if n > LOCAL_EDGES:
        raise ValueError(f"{n} edges: this kernel holds the graph in each task and takes at most {LOCAL_EDGES}")
    out: dict[int, list[int]] = {}
    for s, t in e.collect():
        out.setdefault(s, []).append(t)
        out.setdefault(t, [])
    return {k: sorted(x) for k, x in out.items()}


def betweenness(e: DataFrame) -> DataFrame:
    """id, betweenness (not normalised, along out-edges): dependencies of each source in parallel, summed by vertex."""
    e = e.distinct()
    spark = e.sparkSession
    held = spark.sparkContext.broadcast(adjacency(e))
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        adj = held.value
        total: dict[int, float] = {}
        for b in batches:
            for s in b["id"]:
                dist, paths, before, order = {s: 0}, {s: 1.0}, {s: []}, [s]
                for u in order:
                    for t in adj[u]:
                        if t not in dist:
                            dist[t], paths[t], before[t] = dist[u] + 1, 0.0, []
                            order.append(t)
                        if dist[t] == dist[u] + 1:
                            paths[t] += paths[u]
                            before[t].append(u)
                need = dict.fromkeys(order, 0.0)
                for t in reversed(order):
                    for u in before[t]:
                        need[u] += paths[u] / paths[t] * (1 + need[t])
                    if t != s:
                        total[t] = total.get(t, 0.0) + need[t]
        yield pd.DataFrame({"id": list(total), "part": list(total.values())}).astype({"id": "int64", "part": "float64"})

    part = v.repartition("id").mapInPandas(run, "id long, part double").groupBy("id").agg(F.sum("part").alias("part"))
    return v.join(part, "id", "left").select("id", F.coalesce("part", F.lit(0.0)).alias("betweenness"))


def expand(r: set, p: set, x: set, adj: dict, out: list, least: int) -> None:
    """Bron-Kerbosch with pivoting."""
    if not p and not x:
        if len(r) >= least:
            out.append(sorted(r))
        return
    pivot = max(p | x, key=lambda u: len(p & adj[u]))
    for v in sorted(p - adj[pivot]):
        expand(r | {v}, p & adj[v], x & adj[v], adj, out, least)
        p = p - {v}
        x = x | {v}


def maximal_cliques(e: DataFrame, least: int = 2) -> DataFrame:
    """members (sorted array) of every maximal clique, each once: at its member of lowest (degree, id).

    A task per vertex gets the edges among its neighbours; the order by degree keeps the part that it searches small.
    """
    u = undirected(e)
    both = u.select(F.col("a").alias("v"), F.col("b").alias("w")).union(u.select("b", "a"))
    deg = both.groupBy("v").agg(F.count("*").alias("d"))
    both = both.join(deg, "v").join(deg.select(F.col("v").alias("w"), F.col("d").alias("dw")), "w")
    later = F.struct("d", "v") < F.struct(F.col("dw").alias("d"), F.col("w").alias("v"))
    near = cut(both.select("v", "w", later.alias("later")))
    # Triangles from their lowest vertex, which has few later ones: paths over vertices of many edges would be their squares.
    x, y = near.where("later").alias("x"), near.where("later").alias("y")
    wedge = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.w") < F.col("y.w"))).select(F.col("x.v").alias("i"), F.col("x.w").alias("a"), F.col("y.w").alias("b"))
    corner = lambda v, p, q: F.struct(F.col(v).alias("v"), F.col(p).alias("p"), F.col(q).alias("q"))
    pairs = wedge.join(near.where("v < w").select(F.col("v").alias("a"), F.col("w").alias("b")), ["a", "b"]).select(F.explode(F.array(corner("i", "a", "b"), corner("a", "i", "b"), corner("b", "i", "a"))).alias("t")).select("t.*")
    among = pairs.withColumn("later", F.lit(False)).union(near.select("v", "w", F.lit(None).cast("long"), "later"))

    def run(key, pdf):
        import pandas as pd

        adj: dict[int, set] = {}
        after, before = set(), set()
        for p, q, later in zip(pdf["p"], pdf["q"], pdf["later"]):
            if q == q and q is not None and not pd.isna(q):
                adj.setdefault(int(p), set()).add(int(q))
                adj.setdefault(int(q), set()).add(int(p))
            else:
                adj.setdefault(int(p), set())
                (after if later else before).add(int(p))
        out: list = []
        expand({int(key[0])}, after, before, adj, out, least)
        return pd.DataFrame({"members": pd.Series(out, dtype=object)})

    return among.groupBy("v").applyInPandas(run, "members array<long>")


def maximal_plexes(e: DataFrame, missing: int = 1, least: int = 3) -> DataFrame:
    """members of every maximal set in which each vertex lacks at most ``missing`` edges to the others.

    Each is found from its smallest vertex, in parallel over vertices. The adjacency goes to every task (its size is
    checked): for more than one missing edge a plex need not be connected.
    """
    adj = adjacency(undirected(e).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    held = e.sparkSession.sparkContext.broadcast({k: set(x) | {u for u, y in adj.items() if k in y} for k, x in adj.items()})
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()

    def fits(group: frozenset, w: int, near: dict) -> bool:
        lacks = [u for u in group if u not in near[w]]
        return len(lacks) <= missing and all(sum(1 for t in group if t != u and t not in near[u]) + 1 <= missing for u in lacks)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        near = held.value
        every = sorted(near)
        out = []
        for b in batches:
            for root in b["id"]:
                stack = [(frozenset([root]), [w for w in every if w > root])]
                while stack:
                    group, rest = stack.pop()
                    rest = [w for w in rest if fits(group, w, near)]
                    if not rest and len(group) >= least and not any(w not in group and fits(group, w, near) for w in every):
                        out.append(sorted(group))
                    for k, w in enumerate(rest):
                        stack.append((group | {w}, rest[k + 1 :]))
        yield pd.DataFrame({"members": pd.Series([list(x) for x in {tuple(m) for m in out}], dtype=object)})

    return v.repartition("id").mapInPandas(run, "members array<long>").distinct()


def percolated_members(cliques: DataFrame, k: int = 3) -> DataFrame:
    """community (a number), v: communities are components of cliques of at least k members that share k - 1 vertices. Every clique is
    tied to the first one with each of its sets of k - 1 vertices, so that a vertex of many cliques doesn't make pairs of them."""
    c = cut(cliques.where(F.size("members") >= k).select(F.sort_array("members").alias("members"), F.monotonically_increasing_id().alias("c")))
    sub = c.select("c", "members", F.array().cast("array<long>").alias("s"), F.lit(0).alias("i"))
    for j in range(k - 1):
        at = sub.select("c", "members", "s", F.explode(F.sequence("i", F.size("members") - (k - 1 - j))).alias("i"))
        sub = at.select("c", "members", F.concat("s", F.array(F.get("members", F.col("i")))).alias("s"), (F.col("i") + 1).alias("i"))
    star = sub.select("c", F.min("c").over(Window.partitionBy("s")).alias("m")).where("c <> m").distinct()
    comp = components(star.select(F.col("c").alias("src"), F.col("m").alias("dst")))
    m = c.select("c", F.explode("members").alias("v"))
    return m.join(comp, m["c"] == comp["node"], "left").select(F.coalesce("component", "c").alias("community"), "v").distinct()


def percolation(cliques: DataFrame, k: int = 3) -> DataFrame:
    """community, v: as in ``percolated_members``, named by all members. Every row holds its community's name, so that rows are spread first."""
    m = cut(percolated_members(cliques, k))
    name = m.groupBy(F.col("community").alias("_k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("v")), lambda v: v.cast("string")), ",").alias("community"))
    return m.select(F.col("community").alias("_k"), "v").repartition(tasks(m)).join(name, "_k").select("community", "v")


def edge_distances(e: DataFrame) -> DataFrame:
    """e1, e2, distance of edges that share an endpoint: 1 - Jaccard of the inclusive neighbourhoods of the other two."""
    u = undirected(e)
    both = u.select(F.col("a").alias("v"), F.col("b").alias("w")).union(u.select("b", "a"))
    hood = both.groupBy("v").agg(F.array_union(F.collect_set("w"), F.array(F.first("v"))).alias("hood"))
    x, y = both.alias("x"), both.alias("y")
    pairs = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.w") < F.col("y.w"))).select(F.col("x.v").alias("k"), F.col("x.w").alias("i"), F.col("y.w").alias("j"))
    p = pairs.join(hood.select(F.col("v").alias("i"), F.col("hood").alias("hi")), "i").join(hood.select(F.col("v").alias("j"), F.col("hood").alias("hj")), "j")
    d = 1 - F.size(F.array_intersect("hi", "hj")) / F.size(F.array_union("hi", "hj"))
    edge = lambda a, b: F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    return p.select(edge("k", "i").alias("e1"), edge("k", "j").alias("e2"), d.alias("distance"))


def single_linkage(pairs: DataFrame, level: float) -> DataFrame:
    """Clusters below a height: components of the pairs (src, dst, distance) that are strictly nearer."""
    return components(pairs.where(F.col("distance") < level).select("src", "dst"))


def link_communities(e: DataFrame) -> tuple[float, dict[str, int]]:
    """(best partition density, cluster of each edge "a-b") over all heights of single linkage.

    Merging in height order is sequential; it runs on the driver over the sparse list of touching edge pairs, whose number
    is checked.
    """
    d = edge_distances(e)
    n = d.count()
    if n > LOCAL_EDGES:
        raise ValueError(f"{n} pairs of touching edges: at most {LOCAL_EDGES}")
    u = [f"{a}-{b}" for a, b in undirected(e).select("a", "b").collect()]
    up = {x: x for x in u}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def density() -> float:
        edges: dict[str, int] = {}
        nodes: dict[str, set] = {}
        for x in u:
            r = top(x)
            edges[r] = edges.get(r, 0) + 1
            nodes.setdefault(r, set()).update(x.split("-"))
        return 2 / len(u) * sum(m * (m - (len(nodes[r]) - 1)) / ((len(nodes[r]) - 2) * (len(nodes[r]) - 1)) for r, m in edges.items() if len(nodes[r]) > 2) if u else 0.0

    best, found = density(), {x: top(x) for x in u}
    rows = sorted((h, a, b) for a, b, h in d.collect())
    k = 0
    while k < len(rows):
        h = rows[k][0]
        while k < len(rows) and rows[k][0] == h:
            up[top(rows[k][1])] = top(rows[k][2])
            k += 1
        if (now := density()) > best + 1e-12:
            best, found = now, {x: top(x) for x in u}
    names: dict[str, int] = {}
    return best, {x: names.setdefault(found[x], len(names)) for x in sorted(found)}


def summary(e: DataFrame) -> DataFrame:
    """One row: n, m, density, mean and variance of the in- and out-degree, transitivity, assortativity."""
    e = e.where("src <> dst").distinct()
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    o, i = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    deg = v.join(o, "id", "left").join(i, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    base = deg.agg(F.count("*").alias("n"), F.sum("o").alias("m"), F.round(F.avg("o"), 6).alias("degree"), F.round(F.var_samp("o"), 6).alias("var_out"), F.round(F.var_samp("i"), 6).alias("var_in"))
    u = undirected(e)
    x, y, z = u.alias("x"), u.alias("y"), u.alias("z")
    tri = x.join(y, F.col("x.b") == F.col("y.a")).join(z, (F.col("z.a") == F.col("x.a")) & (F.col("z.b") == F.col("y.b"))).agg(F.count("*").alias("triangles"))
    wedge = u.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("wedges"))
    mix = e.join(deg.select(F.col("id").alias("src"), "o"), "src").join(deg.select(F.col("id").alias("dst"), "i"), "dst").agg(F.round(F.corr("o", "i"), 6).alias("assortativity"))
    all_ = base.crossJoin(tri).crossJoin(wedge).crossJoin(mix)  # one row each
    return all_.select("n", "m", F.round(F.col("m") / (F.col("n") * (F.col("n") - 1)), 6).alias("density"), "degree", "var_out", "var_in", "triangles", F.round(3 * F.col("triangles") / F.col("wedges"), 6).alias("transitivity"), "assortativity")


# Queries ----------------------------------------------------------------------------------------------------------


def comm(spark, d):
    return classified(spark, d).where(F.col("cls") == ADDR).select(F.col("sender").alias("src"), F.col("other").alias("dst")).distinct()


def mutual(spark, d):
    return mutual_edges(social.purchase_edges(spark, d))


def follower_graph(spark, d):
    return reverse(social.explicit_edges(spark, d))


def core_graph(spark, d):
    return induced(social.explicit_edges(spark, d), social.users(spark, d).where("is_core"))


def two_hop_explicit(spark, d):
    e = social.explicit_edges(spark, d)
    return reach(e, e).select("src", "n", "ids")


def two_hop_comm(spark, d):
    e = comm(spark, d)
    return reach(e, e.union(reverse(e))).select("src", "n", "ids")


def network_union(spark, d):
    return social.explicit_edges(spark, d).union(social.purchase_edges(spark, d)).distinct()


def network_intersection(spark, d):
    return social.explicit_edges(spark, d).join(social.purchase_edges(spark, d), ["src", "dst"], "left_semi")


def presence_matrix(spark, d):
    p = social.explicit_edges(spark, d).withColumn("net", F.lit("explicit")).union(social.purchase_edges(spark, d).withColumn("net", F.lit("purchase"))).union(comm(spark, d).withColumn("net", F.lit("comm")))
    return p.groupBy("src", "dst").pivot("net", ["explicit", "purchase", "comm"]).count().select("src", "dst", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("explicit", "purchase", "comm")])


def overlap_matrix(spark, d):
    """Jaccard and overlap coefficients of the networks, from one membership table."""
    p = presence_matrix(spark, d)
    nets = ("explicit", "purchase", "comm")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in nets for b in nets]
    row = p.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("both"), F.col(f"{a}_{a}").alias("na"), F.col(f"{b}_{b}").alias("nb")) for a in nets for b in nets if a < b])
    x = row.select(F.explode(pairs).alias("x")).select("x.*")
    union = F.col("na") + F.col("nb") - F.col("both")
    return x.select("a", "b", F.round(F.when(union == 0, 1.0).otherwise(F.col("both") / union), 6).alias("jaccard"), F.round(F.when(F.least("na", "nb") == 0, 1.0).otherwise(F.col("both") / F.least("na", "nb")), 6).alias("overlap"))


def shared_neighbors(spark, d):
    return shared(social.explicit_edges(spark, d), 3)


def weak_components(spark, d):
    return components(mutual(spark, d))


def component_histogram(spark, d):
    return weak_components(spark, d).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def pagerank_fixed(spark, d):
    return pagerank(social.explicit_edges(spark, d), 5).select("id", F.round("rank", 9).alias("rank"))


def graph_summary(spark, d):
    return summary(social.purchase_edges(spark, d))


def betweenness_all(spark, d):
    return betweenness(social.purchase_edges(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


def cliques(spark, d):
    return maximal_cliques(mutual(spark, d)).select(F.concat_ws(",", F.transform("members", lambda v: v.cast("string"))).alias("members"))


def clique_per_vertex(spark, d):
    """Number of cliques and the largest (ties: the smallest members) of each vertex."""
    c = maximal_cliques(mutual(spark, d))
    x = c.select(F.explode("members").alias("v"), "members", F.size("members").alias("n"))
    w = Window.partitionBy("v").orderBy(F.desc("n"), "members")
    x = x.withColumn("k", F.row_number().over(w)).withColumn("cliques", F.count("*").over(Window.partitionBy("v")))
    return x.where("k = 1").select("v", "cliques", "n")


def plexes(spark, d):
    return maximal_plexes(mutual(spark, d)).select(F.concat_ws(",", F.transform("members", lambda v: v.cast("string"))).alias("members"))


def percolated(spark, d):
    return percolation(maximal_cliques(social.purchase_edges(spark, d), 3))


def edge_distance(spark, d):
    return edge_distances(mutual(spark, d)).select("e1", "e2", F.round("distance", 6).alias("distance"))


def vertex_communities(spark, d):
    """Clusters of vertices, which may overlap: the ends of each cluster's edges."""
    return edge_communities(spark, d).select("cluster", F.explode(F.split("edge", "-")).alias("v")).groupBy("cluster").agg(F.collect_set(F.col("v").cast("long")).alias("m")).select("cluster", F.array_join(F.transform(F.sort_array("m"), lambda x: x.cast("string")), ",").alias("members"))


def linkage(spark, d):
    """Levels of the single linkage of the mutual graph's edges."""
    e = undirected(mutual(spark, d)).select(F.concat_ws("-", "a", "b").alias("e"))
    from quern.operators.tables import ranked

    ids = ranked(e, "e")
    p = edge_distances(mutual(spark, d)).withColumn("distance", F.round("distance", 6))
    p = p.join(ids.select(F.col("e").alias("e1"), F.col("rank").alias("src")), "e1").join(ids.select(F.col("e").alias("e2"), F.col("rank").alias("dst")), "e2")
    return linkage_levels(p.select("src", "dst", "distance"), ids.count())


def community_statistics(spark, d):
    """Percolated communities: how many, how many vertices they cover of all, sizes, and the share of the largest."""
    c = cut(percolated_members(maximal_cliques(social.purchase_edges(spark, d), 3)))
    s = c.groupBy("community").agg(F.count("*").alias("n"))
    n = social.users(spark, d).agg(F.count("*").alias("users"))
    one = s.agg(F.count("*").alias("communities"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most")).crossJoin(c.agg(F.countDistinct("v").alias("covered"))).crossJoin(n)  # one row each
    return one.select("communities", "mean", "least", "most", F.round(F.col("covered") / F.col("users"), 6).alias("coverage"), F.round(F.col("most") / F.col("users"), 6).alias("largest"))


def community_membership(spark, d):
    """Number of percolated communities and of edge clusters of each vertex that has any."""
    p = percolated_members(maximal_cliques(social.purchase_edges(spark, d), 3)).groupBy("v").agg(F.count("*").alias("percolated"))
    k = edge_communities(spark, d).select("cluster", F.explode(F.transform(F.split("edge", "-"), lambda x: x.cast("long"))).alias("v")).groupBy("v").agg(F.countDistinct("cluster").alias("clusters"))
    return p.join(k, "v", "full").select("v", F.coalesce("percolated", F.lit(0)).alias("percolated"), F.coalesce("clusters", F.lit(0)).alias("clusters"))


def component_summary(spark, d):
    """Weak and strong components of the replies and their largest, and the mean degree over n - 1."""
    e = cut(social.purchase_edges(spark, d))
    size = lambda c: c.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.max("n").alias("top"))
    w, s = size(components(e)).select(F.col("k").alias("weak"), F.col("top").alias("largest_weak")), size(strong_components(e)).select(F.col("k").alias("strong"), F.col("top").alias("largest_strong"))
    n = e.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.countDistinct("v").alias("n"), (F.count("*") / 2).alias("m"))
    return w.crossJoin(s).crossJoin(n).select("weak", "largest_weak", "strong", "largest_strong", F.round(F.col("m") / F.col("n") / (F.col("n") - 1), 6).alias("degree"))  # one row each


def edge_communities(spark, d):
    best, found = link_communities(mutual(spark, d))
    return spark.createDataFrame([(k, c, round(best, 6)) for k, c in found.items()] or [], "edge string, cluster int, density double")


MU = "mu AS (SELECT src, dst FROM purchase_edges e WHERE EXISTS (SELECT 1 FROM purchase_edges r WHERE r.src = e.dst AND r.dst = e.src))"
CM = "cm AS (SELECT DISTINCT sender AS src, other AS dst FROM classified WHERE cls = 'ADDR')"
PR = ["pe AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM explicit_edges)", "pv AS (SELECT src AS id FROM explicit_edges UNION SELECT dst FROM explicit_edges)", "pn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pv)", "r0 AS (SELECT id, 1.0 / n AS rank FROM pv, pn)"]
for _k in range(5):
    PR.append(f"""r{_k + 1} AS (SELECT v.id, 0.2 / n + 0.8 * (coalesce(g.got, 0) + l.lost / n) AS rank FROM pv v CROSS JOIN pn CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{_k} WHERE id NOT IN (SELECT src FROM explicit_edges)) l
      LEFT JOIN (SELECT dst, sum(rank * w) AS got FROM pe JOIN r{_k} ON src = id GROUP BY 1) g ON g.dst = v.id)""")
SHORTEST = ["l0 AS (SELECT DISTINCT id AS s, id AS v, 1.0::DOUBLE AS p FROM (SELECT src AS id FROM purchase_edges UNION SELECT dst FROM purchase_edges))"]
for _k in range(1, 9):
    _seen = " UNION ALL ".join(f"SELECT s, v FROM l{_i}" for _i in range(_k))
    SHORTEST.append(f"l{_k} AS (SELECT l.s, e.dst AS v, sum(l.p) AS p FROM l{_k - 1} l JOIN purchase_edges e ON e.src = l.v WHERE NOT EXISTS (SELECT 1 FROM ({_seen}) x WHERE x.s = l.s AND x.v = e.dst) GROUP BY ALL)")
SHORTEST.append("sp AS (" + " UNION ALL ".join(f"SELECT s, v, p, {_k} AS d FROM l{_k}" for _k in range(9)) + ")")
#: Adjacency lists, all cliques in ascending order, the maximal ones.
CLIQUES = ["ad AS (SELECT src AS v, list(dst ORDER BY dst) AS n FROM mu GROUP BY 1)", "cl(m) AS (SELECT [v] FROM ad UNION ALL SELECT list_append(c.m, u.v) FROM cl c JOIN ad u ON u.v > c.m[-1] AND list_has_all(u.n, c.m))",
           "mc AS (SELECT m FROM cl WHERE len(m) > 1 AND NOT EXISTS (SELECT 1 FROM ad WHERE list_has_all(ad.n, cl.m)))"]
#: Triangles that share an edge are one community: components of their edges, then vertices (c, v).
PERCOLATION = ["pu AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS e FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM purchase_edges))",
               "pt AS (SELECT x.e AS e1, y.e AS e2, z.e AS e3 FROM pu x JOIN pu y ON y.a = x.b JOIN pu z ON z.a = x.a AND z.b = y.b)", "pa AS (SELECT e1 AS x, e2 AS y FROM pt UNION SELECT e2, e1 FROM pt UNION SELECT e1, e3 FROM pt UNION SELECT e3, e1 FROM pt)",
               "pc(e, c) AS (SELECT DISTINCT x, x FROM pa UNION SELECT pa.y, pc.c FROM pc JOIN pa ON pa.x = pc.e)", "pm AS (SELECT DISTINCT c, unnest([a, b]) AS v FROM (SELECT e, min(c) AS c FROM pc GROUP BY 1) JOIN pu USING (e))"]
#: Distances of touching edges, components at every height (-1: none merged), the best partition density, its clusters.
LINKS = ["hd AS (SELECT src AS v, dst AS w FROM mu UNION SELECT src, src FROM mu)",
         """ds AS (SELECT least(k, i) || '-' || greatest(k, i) AS e1, least(k, j) || '-' || greatest(k, j) AS e2, round(1 - (SELECT count(*) FROM hd a JOIN hd b ON a.w = b.w WHERE a.v = i AND b.v = j) / (SELECT count(DISTINCT w) FROM hd WHERE v IN (i, j)), 6) AS distance FROM (SELECT x.src AS k, x.dst AS i, y.dst AS j FROM mu x JOIN mu y ON x.src = y.src AND x.dst < y.dst))""",
         "lv AS (SELECT DISTINCT distance AS lv FROM ds UNION SELECT -1)", "le AS (SELECT DISTINCT least(src, dst) || '-' || greatest(src, dst) AS e FROM mu)", "db AS (SELECT e1, e2, distance FROM ds UNION ALL SELECT e2, e1, distance FROM ds)",
         "lc(lv, e, c) AS (SELECT lv, e, e FROM lv, le UNION SELECT l.lv, d.e2, l.c FROM lc l JOIN db d ON d.e1 = l.e AND d.distance <= l.lv)",
         "lk AS (SELECT lv, e, min(c) AS k FROM lc GROUP BY ALL)",
         "ld AS (SELECT lv, 2 / (SELECT count(*) FROM le) * sum(CASE WHEN n > 2 THEN m * (m - (n - 1)) / ((n - 2) * (n - 1)) ELSE 0 END) AS density FROM (SELECT lv, k, count(DISTINCT e) AS m, count(DISTINCT v) AS n FROM (SELECT lv, k, e, unnest(string_split(e, '-')) AS v FROM lk) GROUP BY ALL) GROUP BY 1)",
         "bl AS (SELECT lv, density FROM ld ORDER BY round(density, 9) DESC, lv LIMIT 1)", "bc AS (SELECT e, k, density FROM lk JOIN bl USING (lv))"]
QUERIES = {
    "mutual": (mutual, sql("SELECT src, dst FROM mu", MU)),
    "follower_graph": (follower_graph, sql("SELECT dst AS src, src AS dst FROM explicit_edges")),
    "core_graph": (core_graph, sql("SELECT src, dst FROM explicit_edges WHERE src IN (SELECT id FROM users WHERE is_core) AND dst IN (SELECT id FROM users WHERE is_core)")),
    "two_hop_explicit": (two_hop_explicit, sql("SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS ids FROM (SELECT src, dst FROM explicit_edges UNION SELECT f.src, s.dst FROM explicit_edges f JOIN explicit_edges s ON f.dst = s.src) GROUP BY 1")),
    "two_hop_comm": (two_hop_comm, sql("SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS ids FROM (SELECT src, dst FROM cm UNION SELECT f.src, s.dst FROM cm f JOIN (SELECT src, dst FROM cm UNION SELECT dst, src FROM cm) s ON f.dst = s.src) GROUP BY 1", CM)),
    "network_union": (network_union, sql("SELECT src, dst FROM explicit_edges UNION SELECT src, dst FROM purchase_edges")),
    "network_intersection": (network_intersection, sql("SELECT src, dst FROM explicit_edges INTERSECT SELECT src, dst FROM purchase_edges")),
    "presence_matrix": (presence_matrix, sql("SELECT src, dst, count(*) FILTER (net = 1) AS explicit, count(*) FILTER (net = 2) AS purchase, count(*) FILTER (net = 3) AS comm FROM (SELECT src, dst, 1 AS net FROM explicit_edges UNION ALL SELECT src, dst, 2 FROM purchase_edges UNION ALL SELECT src, dst, 3 FROM cm) GROUP BY ALL", CM)),
    "overlap_matrix": (overlap_matrix, sql("""SELECT x.net AS a, y.net AS b, round(count(*) FILTER (x.src = y.src) / max(u), 6) AS jaccard, round(count(*) FILTER (x.src = y.src) / max(l), 6) AS overlap FROM (SELECT x.net AS nx, y.net AS ny, least(x.n, y.n) AS l,
      (SELECT count(*) FROM (SELECT src, dst FROM nets WHERE net = x.net UNION SELECT src, dst FROM nets WHERE net = y.net)) AS u FROM (SELECT net, count(*) AS n FROM nets GROUP BY 1) x, (SELECT net, count(*) AS n FROM nets GROUP BY 1) y) t
      JOIN nets x ON x.net = nx JOIN nets y ON y.net = ny AND x.src = y.src AND x.dst = y.dst WHERE x.net < y.net GROUP BY ALL""", CM, "nets AS (SELECT src, dst, 'explicit' AS net FROM explicit_edges UNION ALL SELECT src, dst, 'purchase' FROM purchase_edges UNION ALL SELECT src, dst, 'comm' FROM cm)")),
    "shared_neighbors": (shared_neighbors, sql("SELECT x.src AS a, y.src AS b, count(*) AS n FROM explicit_edges x JOIN explicit_edges y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING count(*) > 2")),
    "weak_components": (weak_components, sql("SELECT node, min(c) AS component FROM rc GROUP BY 1", MU, "rc(node, c) AS (SELECT DISTINCT src, src FROM mu UNION SELECT m.dst, rc.c FROM rc JOIN mu m ON m.src = rc.node)", recursive=True)),
    "component_histogram": (component_histogram, sql("SELECT size, count(*) AS n FROM (SELECT c, count(*) AS size FROM (SELECT node, min(c) AS c FROM rc GROUP BY 1) GROUP BY 1) GROUP BY 1", MU, "rc(node, c) AS (SELECT DISTINCT src, src FROM mu UNION SELECT m.dst, rc.c FROM rc JOIN mu m ON m.src = rc.node)", recursive=True)),
    "pagerank_fixed": (pagerank_fixed, sql("SELECT id, round(rank, 9) AS rank FROM r5", *PR)),
    "graph_summary": (graph_summary, sql("""SELECT n, m, round(m / (n * (n - 1)), 6) AS density, degree, var_out, var_in, triangles, round(3 * triangles / wedges, 6) AS transitivity, assortativity FROM
      (SELECT count(*) AS n, CAST(sum(o) AS BIGINT) AS m, round(avg(o), 6) AS degree, round(var_samp(o), 6) AS var_out, round(var_samp(i), 6) AS var_in FROM dg),
      (SELECT count(*) AS triangles FROM un x JOIN un y ON x.b = y.a JOIN un z ON z.a = x.a AND z.b = y.b), (SELECT sum(k * (k - 1) / 2) AS wedges FROM (SELECT v, count(*) AS k FROM (SELECT a AS v FROM un UNION ALL SELECT b FROM un) GROUP BY 1)),
      (SELECT round(corr(s.o, t.i), 6) AS assortativity FROM purchase_edges e JOIN dg s ON s.id = e.src JOIN dg t ON t.id = e.dst)""",
      "dg AS (SELECT id, (SELECT count(*) FROM purchase_edges e WHERE e.src = id) AS o, (SELECT count(*) FROM purchase_edges e WHERE e.dst = id) AS i FROM (SELECT src AS id FROM purchase_edges UNION SELECT dst FROM purchase_edges))",
      "un AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM purchase_edges)")),
    "betweenness": (betweenness_all, sql("""SELECT v.id, round(coalesce(b.b, 0), 6) AS betweenness FROM (SELECT src AS id FROM purchase_edges UNION SELECT dst FROM purchase_edges) v LEFT JOIN
      (SELECT x.v, sum(x.p * y.p / z.p) AS b FROM sp x JOIN sp y ON y.s = x.v AND y.v <> x.v JOIN sp z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s <> x.v AND x.s <> y.v GROUP BY 1) b ON b.v = v.id""", *SHORTEST)),
    "cliques": (cliques, sql("SELECT array_to_string(m, ',') AS members FROM mc", MU, *CLIQUES, recursive=True)),
    "clique_per_vertex": (clique_per_vertex, sql("SELECT v, count(*) AS cliques, CAST(max(n) AS INTEGER) AS n FROM (SELECT unnest(m) AS v, len(m) AS n FROM mc) GROUP BY 1", MU, *CLIQUES, recursive=True)),
    "plexes": (plexes, sql("SELECT array_to_string(m, ',') AS members FROM pl WHERE len(m) >= 3 AND NOT EXISTS (SELECT 1 FROM ad u LEFT JOIN ad x ON x.v = list_filter(pl.m, lambda y: NOT list_contains(u.n, y))[1] WHERE NOT list_contains(pl.m, u.v) AND len(list_filter(pl.m, lambda y: NOT list_contains(u.n, y))) <= 1 AND (x.v IS NULL OR len(list_intersect(x.n, pl.m)) = len(pl.m) - 1))", MU, CLIQUES[0],
      """pl(m) AS (SELECT [v] FROM ad UNION ALL SELECT list_append(p.m, u.v) FROM pl p JOIN ad u ON u.v > p.m[-1] LEFT JOIN ad x ON x.v = list_filter(p.m, lambda y: NOT list_contains(u.n, y))[1] WHERE len(list_filter(p.m, lambda y: NOT list_contains(u.n, y))) <= 1 AND (x.v IS NULL OR len(list_intersect(x.n, p.m)) = len(p.m) - 1))""", recursive=True)),
    "percolation": (percolated, sql("SELECT c.community, p.v FROM pm p JOIN (SELECT c, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS community FROM pm GROUP BY 1) c ON c.c = p.c", *PERCOLATION, recursive=True)),
    "community_statistics": (community_statistics, sql("SELECT count(*) AS communities, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, round((SELECT count(DISTINCT v) FROM pm) / (SELECT count(*) FROM users), 6) AS coverage, round(max(n) / (SELECT count(*) FROM users), 6) AS largest FROM (SELECT c, count(*) AS n FROM pm GROUP BY 1)", *PERCOLATION, recursive=True)),
    "component_summary": (component_summary, sql("""SELECT weak, largest_weak, strong, largest_strong, round(m / n / (n - 1), 6) AS degree FROM (SELECT count(*) AS weak, max(k) AS largest_weak FROM (SELECT c, count(*) AS k FROM (SELECT node, min(c) AS c FROM wc GROUP BY 1) GROUP BY 1)),
      (SELECT count(*) AS strong, max(k) AS largest_strong FROM (SELECT c, count(*) AS k FROM (SELECT x.s AS node, min(x.v) AS c FROM cl x JOIN cl y ON y.s = x.v AND y.v = x.s GROUP BY 1) GROUP BY 1)), (SELECT count(DISTINCT src) AS q, count(*) AS m FROM purchase_edges), (SELECT count(*) AS n FROM (SELECT src FROM purchase_edges UNION SELECT dst FROM purchase_edges))""",
      "wc(node, c) AS (SELECT DISTINCT src, src FROM (SELECT src FROM purchase_edges UNION SELECT dst FROM purchase_edges) UNION SELECT e.b, wc.c FROM wc JOIN (SELECT src AS a, dst AS b FROM purchase_edges UNION SELECT dst, src FROM purchase_edges) e ON e.a = wc.node)",
      "cl(s, v) AS (SELECT DISTINCT src, src FROM (SELECT src FROM purchase_edges UNION SELECT dst FROM purchase_edges) UNION SELECT cl.s, e.dst FROM cl JOIN purchase_edges e ON e.src = cl.v)", recursive=True)),
    "edge_distance": (edge_distance, sql("""SELECT least(k, i) || '-' || greatest(k, i) AS e1, least(k, j) || '-' || greatest(k, j) AS e2, round(1 - (SELECT count(*) FROM hd a JOIN hd b ON a.w = b.w WHERE a.v = i AND b.v = j) / (SELECT count(DISTINCT w) FROM hd WHERE v IN (i, j)), 6) AS distance
      FROM (SELECT x.src AS k, x.dst AS i, y.dst AS j FROM mu x JOIN mu y ON x.src = y.src AND x.dst < y.dst)""", MU, "hd AS (SELECT src AS v, dst AS w FROM mu UNION SELECT src, src FROM mu)")),
    "link_communities": (edge_communities, sql("SELECT e AS edge, CAST(dense_rank() OVER (ORDER BY k) - 1 AS INTEGER) AS cluster, round(density, 6) AS density FROM bc", MU, *LINKS, recursive=True)),
    "vertex_communities": (vertex_communities, sql("SELECT CAST(cluster AS INTEGER) AS cluster, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS members FROM (SELECT DISTINCT cluster, unnest([CAST(split_part(e, '-', 1) AS BIGINT), CAST(split_part(e, '-', 2) AS BIGINT)]) AS v FROM (SELECT e, dense_rank() OVER (ORDER BY k) - 1 AS cluster FROM bc)) GROUP BY 1", MU, *LINKS, recursive=True)),
    "community_membership": (community_membership, sql("SELECT coalesce(p.v, k.v) AS v, coalesce(p.n, 0) AS percolated, coalesce(k.n, 0) AS clusters FROM (SELECT v, count(*) AS n FROM pm GROUP BY 1) p FULL JOIN (SELECT v, count(DISTINCT k) AS n FROM (SELECT k, unnest([CAST(split_part(e, '-', 1) AS BIGINT), CAST(split_part(e, '-', 2) AS BIGINT)]) AS v FROM bc) GROUP BY 1) k ON k.v = p.v", MU, *LINKS, *PERCOLATION, recursive=True)),
    "linkage": (linkage, sql("SELECT height, clusters FROM (SELECT lv AS height, lag(n) OVER (ORDER BY lv) AS clusters, n FROM lt) WHERE n < clusters UNION ALL SELECT NULL, min(n) FROM lt", MU, *LINKS, "lt AS (SELECT lv, count(DISTINCT k) AS n FROM lk GROUP BY 1)", recursive=True)),
}
