"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh 5, 2, 1, repeating. Targets share all words by weight, stop at
``most`` times the source's own size, and the excess is shared again: that is one water level L with
target = min(most * size, weight * L), found in one pass over the per-source totals.

Within a source every document expects target / size copies. Along (size, doc_id) their prefix sums plus one
offset of the source cross integer boundaries; a document is emitted once per boundary crossed. Ordering by size
makes neighbours alike, so the words taken differ from the target by about one document at most.

Ranks within a source are exact at any size: rows go to ranges of (source, size, doc_id) that are balanced by rows, so a
source with a third of all rows is spread over many tasks; a row's rank is its place in its range plus the counts of the
source in the ranges before, a table of one row per range and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import drop_staged, n_words, stage

WEIGHTS, MOST, BROADCAST_ROWS, SALT = (5, 2, 1), 3, 200_000, 64


def offset(source: Column) -> Column:
    """The source's offset in [0, 1): seven hex digits of its name's md5, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("")))), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` has source, source_size, one row per source; adds target. All integers until one division."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source, not per document
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    # Sources reach their cap in the order of cap / weight: the level is set by the first one that stays below.
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = (t.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_left", F.sum("_w").over(everything))
         .withColumn("_left", F.col("_left") - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
         .withColumn("_rest", F.col("_all") - F.coalesce(F.sum("_cap").over(upto), F.lit(0))))
    below = F.col("_cap") * F.col("_left") > F.col("_w") * F.col("_rest")
    first = F.min(F.when(below, F.struct((F.col("_cap") / F.col("_w")).alias("k"), F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("s"), F.col("_rest").alias("rest"), F.col("_left").alias("left")))).over(everything)
    t = t.withColumn("_first", first)
    # At the level, _rest/_left of the first source below its cap: everyone before is full, everyone after is not.
    full = F.col("_first").isNull() | (F.col("_cap") * F.col("_first.left") <= F.col("_w") * F.col("_first.rest"))
    return t.select("source", "source_size", F.when(full, F.col("_cap").cast("double")).otherwise(
        (F.col("_w") * F.col("_first.rest")).cast("double") / F.col("_first.left").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, size, source, source_size, target, copies, taken (= copies * size) and those of ``keep``.

    Null text has size 0; a null source is a source of its own, last in order. Documents of size 0 may be emitted
    but take no words. A source without words has target 0 and no copies. Repeated rows are documents of their
    own; ties in (size, doc_id) are places in any order. Empty input gives no rows.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), *keep)
    sized = stage(sized, "mix")
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("_docs"))
    # One row per source; written so that both joins below read it and not the documents.
    goal = stage(targets(per.select("source", "source_size"), weights, most).join(per.select(F.col("source").alias("_s"), "_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")

    # A salt is the last key, so even a row that is repeated very often doesn't fill one range.
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), F.col("_salt")]
    salted = sized.withColumn("_salt", F.monotonically_increasing_id() % SALT)
    ranged = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    ranged = stage(ranged, "ranged")  # _at is (range, place) from here on
    drop_staged(sized)
    pid = F.shiftright("_at", 33)
    spans = ranged.groupBy(pid.alias("_pid"), "source").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    spans = stage(spans.select("_pid", F.col("source").alias("_s"), "_first", F.coalesce(before, F.lit(0)).alias("_before")), "spans")
    g = goal.select(F.col("source").alias("_s"), "source_size", "target")
    spans = spans.join(g.withColumnRenamed("_s", "_g"), F.col("_s").eqNullSafe(F.col("_g"))).drop("_g")
    if spans.count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    ranked = ranged.withColumn("_p", pid)
    ranked = ranked.join(spans, (F.col("_p") == F.col("_pid")) & F.col("source").eqNullSafe(F.col("_s")))
    ranked = ranked.withColumn("_k", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    k, u = F.col("_k").cast("double"), offset(F.col("source"))
    copies = (F.floor(k * e + u) - F.floor((k - 1) * e + u)).cast("long")
    return ranked.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM p),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS lft,
      row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS k FROM w
      WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rest AS frest, lft AS flft FROM l WHERE cap * lft > w * rest ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN flft IS NULL OR cap * flft <= w * frest THEN CAST(cap AS DOUBLE)
      ELSE CAST(w * frest AS DOUBLE) / CAST(flft AS DOUBLE) END AS target FROM l LEFT JOIN f ON true),
r AS (SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM d),
e AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS e,
      CAST(('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE AS u
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(CAST(k AS DOUBLE) * e + u) - floor(CAST(k - 1 AS DOUBLE) * e + u) AS BIGINT) AS taken FROM e
"""
