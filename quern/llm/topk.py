"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (norm) into buckets whose lengths lie close together. For a query and the k-th best
score it already has, a bucket needs a cosine of at least score / (|query| * longest): above 1 the bucket is skipped.
Else each bucket prunes in the cheaper way for that local threshold: by length, only vectors long enough for the
score even if parallel; or by coordinate, only vectors whose value at the query's largest coordinates lies in the
interval which that cosine leaves open. Surviving vectors are verified by exact integer products.

Every query first meets the longest bucket, which gives it a threshold. Vectors lie in ranges of falling length; a query goes on
to the ranges that its threshold leaves, so blocks of queries that go alike far meet a first part of the ranges. A task
holds one block of queries and one bucket at a time and gives its k best per query, which are merged by a second top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import drop_staged, stage

SCALE, BUCKET, QUERIES, RANGES, K, FOCUS = 256, 2048, 4096, 4096, 5, 3


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def best(ids, scores, k: int):
    """Places of the k best by (score descending, id ascending)."""
    import numpy as np

    if len(ids) > 4 * k:  # all ties of the k-th score stay
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Search:
    """The k best of a block of queries over buckets of (ids, integer matrix). ``floor``: a score that each query's k-th best is
    known to reach (-2**62: none)."""

    def __init__(self, qid, q, floor, k: int, focus: int = FOCUS):
        import numpy as np

        self.q, self.qid, self.k, self.floor = q, qid, k, floor.copy()
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.unit = q / np.maximum(self.norm, 1e-300)[:, None]
        self.top = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :focus]
        self.got = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(q))]

    def bucket(self, ids, m) -> None:
        import numpy as np

        q, norm, slack = self.q, self.norm, 1e-9
        length = np.sqrt((m.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        ids, m, length = ids[order], m[order], length[order]
        dirs = m / np.maximum(length, 1e-300)[:, None]
        reach = norm * length[0]
        # A local threshold above 1: no vector here can reach the score.
        asked = np.flatnonzero((self.floor <= 0) | (self.floor <= reach * (1 + slack)))
        dense, some = [], []
        for i in asked.tolist():
            if self.floor[i] <= 0 or not reach[i]:
                dense.append(i)
                continue
            t = self.floor[i] / reach[i] * (1 - slack)
            long_enough = int(np.searchsorted(-length, -self.floor[i] / norm[i] * (1 - slack), side="right"))
            if not long_enough:
                continue
            # cos(q, p) >= t leaves p_f within q_f * t -+ sqrt((1 - q_f^2)(1 - t^2)), clipped to the cap's edge at 1.
            near = np.ones(long_enough, bool)
            for f in self.top[i]:
                x = self.unit[i, f]
                half = np.sqrt(max(0.0, (1 - x * x) * (1 - t * t)))
                lo = -1.0 if x < 0 and -x > t else x * t - half
                hi = 1.0 if x > 0 and x > t else x * t + half
                v = dirs[:long_enough, f]
                near &= (v >= lo - slack) & (v <= hi + slack)
            pick = np.flatnonzero(near)
            if len(pick) > long_enough // 2:
                dense.append(i)
            elif len(pick):
                some.append((i, pick))
        # Queries that keep most of the bucket share one matrix product; the others verify their few rows. Products
        # in floating point are exact while they stay below 2**53; else integers are used.
        exact = float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * m.shape[1] < 2**53
        if dense:
            s = (q[dense].astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64) if exact else q[dense] @ m.T
            for i, row in zip(dense, s):
                self.add(i, ids, row)
        for i, pick in some:
            self.add(i, ids[pick], m[pick] @ q[i])

    def add(self, i: int, who, s) -> None:
        import numpy as np

        ok = (s >= self.floor[i]) & (who != self.qid[i])
        who, s = np.concatenate((self.got[i][0], who[ok])), np.concatenate((self.got[i][1], s[ok]))
        b = best(who, s, self.k)
        self.got[i] = who[b], s[b]
        if len(b) == self.k:
            self.floor[i] = max(self.floor[i], s[b[-1]])


def meet(rows: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, vec_id, score: per group (_pid, _block) the k best of its queries (_q) over its vectors. Groups are streamed in
    key order, queries first, then one _bucket after the other, so a task holds a block of queries and a bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def matrix(col):
            n = np.diff(col.offsets.to_numpy())
            m = np.zeros((len(n), width), np.int64)
            m[np.arange(width)[None, :] < n[:, None]] = col.flatten().to_numpy()
            return m

        def results():
            if search is None:
                return None
            got = search.got
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(search.qid, [len(x) for x, _ in got])), pa.array(np.concatenate([x for x, _ in got])), pa.array(np.concatenate([s for _, s in got]))],
                names=["query_id", "vec_id", "score"])

        search, key, held = None, None, []

        def close():
            nonlocal search, held
            if held:
                parts = [np.concatenate([h[i] for h in held]) for i in range(3)]
                if key[2]:
                    search = Search(*parts, k)
                elif search is not None:
                    search.bucket(*parts[:2])
            held = []

        for b in batches:
            ks = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)  # _pid, _block, _q, _bucket
            if not len(ks):
                continue
            ids, m, floor = b.column(4).to_numpy(), matrix(b.column(5)), b.column(6).to_numpy()
            cut = [0, *(np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1), len(ks)]
            for s, e in zip(cut[:-1], cut[1:]):
                now = tuple(ks[s].tolist())
                if now != key:
                    close()
                    if key is not None and now[:2] != key[:2]:
                        if (out := results()) is not None:
                            yield out
                        search = None
                    key = now
                held.append((ids[s:e], m[s:e], floor[s:e]))
        close()
        if (out := results()) is not None:
            yield out

    ordered = rows.repartition("_pid", "_block").sortWithinPartitions("_pid", "_block", F.desc("_q"), "_bucket", "vec_id")
    return ordered.select("_pid", "_block", "_q", "_bucket", "vec_id", "x", "floor").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, bucket: int = BUCKET, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query, itself (same vec_id) left out.

    Components are floor(scale * x); vectors that are null or hold a null or non-finite component, and rows with a null
    vec_id, take no part. Shorter vectors count as padded with zeros. Repeated rows are candidates each; of queries that repeat a
    vec_id the least vector asks. A query with fewer than k candidates returns all; ties go to the smaller vec_id. Empty input gives no rows.
    """
    v = F.col("embedding")
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    base = vectors.where(usable(v) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("is_query"), ints.alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    base = stage(base.withColumn("len", length), "vectors")
    n, width = base.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    # Ranges of like length, from the longest vectors on, each in buckets of `bucket` vectors.
    ranges = base.repartitionByRange(min(RANGES, max(1, -(-n // (16 * bucket)))), F.desc("len"), F.col("vec_id")).sortWithinPartitions(F.desc("len"), "vec_id")
    ranges = ranges.withColumn("_at", F.monotonically_increasing_id())
    ranges = stage(ranges.select("vec_id", "x", "len", F.shiftright("_at", 33).alias("_pid"), F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / bucket).alias("_bucket")), "ranges")
    tops = [(r._pid, r.top) for r in ranges.groupBy("_pid").agg(F.max("len").alias("top")).orderBy("_pid").collect()]  # at most RANGES rows
    asks = stage(base.where("is_query").groupBy("vec_id").agg(F.min_by(F.struct("x", "len"), "x").alias("v")).select("vec_id", "v.*"), "queries")
    nq = asks.count()
    drop_staged(base)

    # First thresholds from the longest bucket: every query meets it.
    blocks = max(1, -(-nq // queries))
    none = F.lit(-(1 << 62))
    seeds = ranges.where((F.col("_pid") == tops[0][0]) & (F.col("_bucket") == 0)).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"), "vec_id", "x")
    one = lambda df, q: df.select(F.lit(0).cast("long").alias("_pid"), "_block", F.lit(q).alias("_q"), F.lit(0).cast("long").alias("_bucket"), "vec_id", "x", none.alias("floor"))
    first = meet(one(asks.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), True).unionByName(one(seeds, False)), width, k)
    floors = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("least")).where(F.col("c") == k).select(F.col("query_id").alias("vec_id"), "least")

    # A query goes to the ranges whose longest vector can reach its threshold: a first part of them, as they fall in length.
    need = F.when(F.col("floor") > 0, F.col("floor") / F.col("len") * (1 - 1e-9)).otherwise(F.lit(0.0))
    asks = asks.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("least", none)).withColumn("_reach", F.size(F.filter(F.array(*[F.lit(t) for _, t in tops]), lambda x: x >= need)))
    # Blocks of queries that go alike far.
    asks = asks.repartitionByRange(max(1, -(-nq // (16 * queries))), F.desc("_reach"), F.col("vec_id")).sortWithinPartitions(F.desc("_reach"), "vec_id").withColumn("_at", F.monotonically_increasing_id())
    asks = stage(asks.select("vec_id", "x", "floor", "_reach", F.shiftright("_at", 33).alias("_part"), F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / queries).alias("_chunk")), "asks")
    far = asks.groupBy("_part", "_chunk").agg(F.max("_reach").alias("r")).orderBy("_part", "_chunk").collect()  # a row per block of queries
    reach = sorted(((r.r, r._part, r._chunk) for r in far), key=lambda x: (-x[0], x[1], x[2]))
    spark = vectors.sparkSession
    block = F.broadcast(spark.createDataFrame([(p, c, i, r) for i, (r, p, c) in enumerate(reach)] or [(-1, -1, 0, 0)], "_part long, _chunk long, _block long, _upto int"))
    goes = F.broadcast(spark.createDataFrame([(p, sum(r > j for r, _, _ in reach)) for j, (p, _) in enumerate(tops)], "_pid long, _blocks long"))
    index = F.array(*[F.lit(p) for p, _ in tops])
    asked = asks.join(block, ["_part", "_chunk"]).where("_upto > 0").select(F.explode(F.slice(index, F.lit(1), F.col("_upto"))).alias("_pid"), "_block", F.lit(True).alias("_q"), F.lit(0).cast("long").alias("_bucket"), "vec_id", "x", "floor")
    side = ranges.join(goes, "_pid").where("_blocks > 0").select("_pid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"), F.lit(False).alias("_q"), "_bucket", "vec_id", "x", none.alias("floor"))
    found = meet(asked.unionByName(side), width, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
