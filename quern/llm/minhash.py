"""Near-duplicate groups by b-bit MinHash.

Each text's set of word shingles gives BANDS * ROWS minima. Bands of whole minima make candidates; of each minimum
the low BITS bits are packed into a signature, and the bit counts of two signatures' difference, corrected for the
2**-BITS chance that unlike minima agree, estimate their similarity. Pairs far below the threshold are left; all others
are confirmed on their full sets.

Texts with equal sets are one node throughout, so copies cost one row each. The members of a bucket are first compared
with one member (a star); only buckets that still hold several components are compared across these components, in
blocks of bounded size, and the largest component never with itself. Every link between different sets that shares a
band is thus inside a component or tested.
At similarity 0.8 a pair shares no band with probability (1 - 0.8**5)**38, below 3e-7, and a signature estimate
falls 0.2 short of it with probability below 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop_staged, stage, worker_cache
from quern.llm.graph import components

SHINGLE, PERCENT = 5, 80
BANDS, ROWS, BITS, SLACK = 38, 5, 2, 0.2
HASHES = BANDS * ROWS
WORDS64 = -(-HASHES * BITS // 64)
BLOCK, SPLIT, BITMAP = 1024, 256, 1 << 22


def signature(x, mult, add):
    """The minima of mult * x + add over the set x, per hash function."""
    import numpy as np

    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[None, i : i + 512] * mult[:, None] + add[:, None]).min(axis=1), out=low)
    return low


def functions():
    import numpy as np

    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def set_key(x):
    """128 bits that stand for a set (sorted distinct hashes)."""
    import numpy as np
    import xxhash

    d = xxhash.xxh3_128_digest(x.tobytes())
    return np.frombuffer(d, np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, label, n_shingles, k1, k2 (the set's key), bands, sketch; the last four null for an empty set."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from quern.llm import hashing as H

        mult, add = worker_cache("minhash", functions)
        for b in batches:
            data, offs = H.text_bytes(b.column(1))
            for i, j in H.slices(offs):
                part = H.LOWER[data[offs[i] : offs[j]]]
                _, _, h, first = H.words(part, offs[i : j + 1] - offs[i])
                sets = H.shingles(h, first, shingle)
                keys = [set_key(x) if len(x) else None for x in sets]
                full = [x for x in sets if len(x)]
                low = np.array([signature(x, mult, add) for x in full]).reshape(len(full), HASHES)
                band = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    band = H.mix(band * H.P + low[:, r::ROWS][:, :BANDS])
                band = H.mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                sketch = np.zeros((len(full), WORDS64), np.uint64)
                for k in range(HASHES):
                    sketch[:, k // (64 // BITS)] |= (low[:, k] & np.uint64((1 << BITS) - 1)) << np.uint64(k % (64 // BITS) * BITS)
                it = iter(range(len(full)))
                at = [next(it) if len(x) else None for x in sets]
                lists = lambda m: pa.array([None if r is None else m[r] for r in at], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array([None if k is None else int(k[0]) for k in keys], pa.int64()),
                     pa.array([None if k is None else int(k[1]) for k in keys], pa.int64()), lists(band), lists(sketch.view(np.int64))],
                    names=["doc_id", "label", "n_shingles", "k1", "k2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", label()).mapInArrow(
        run, "doc_id long, label long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>")


def label():
    """By what a second pass finds a row again: its doc_id or, without one, a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("label")


def estimate(a: str, b: str):
    """Collision-corrected similarity of two sketch columns from bit counts."""
    ones = F.lit(0x5555555555555555)
    unlike = F.lit(0)
    for i in range(WORDS64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        unlike = unlike + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
    chance = 2.0**-BITS
    return (1.0 - unlike / float(HASHES) - chance) / (1.0 - chance)


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """nid, set (binary of sorted 64-bit hashes) for ``nodes`` (nid, label, k1, k2), from a second pass over the texts.

    A bitmap of BITMAP hashed labels, a constant size, keeps nearly all other texts from being hashed and shuffled.
    """
    spark = docs.sparkSession
    b = F.pmod(F.xxhash64("label"), F.lit(BITMAP)) + 1  # positions are numbered from 1
    rows = nodes.select(b.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    bitmap = bytearray(BITMAP // 8 + 4096)
    for k, m in rows:  # at most BITMAP / 32768 rows of 4 KB
        bitmap[(k - 1) * 4096 : (k - 1) * 4096 + len(m)] = m
    held = spark.sparkContext.broadcast(bytes(bitmap))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from quern.llm import hashing as H

        bits, seen = np.frombuffer(held.value, np.uint8), set()
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = np.flatnonzero((bits[(at - 1) >> 3] >> ((at - 1) & 7).astype(np.uint8)) & 1)
            # Rows that repeat a label and its text give their set once a task.
            names = [*zip(batch.column(0).take(pa.array(keep)).to_pylist(), batch.column(3).take(pa.array(keep)).to_pylist())]
            new = [i for i, x in enumerate(names) if not (x in seen or seen.add(x))]
            if not new:
                continue
            some = batch.take(pa.array(keep[new]))
            data, offs = H.text_bytes(some.column(1))
            for i, j in H.slices(offs):
                _, _, h, first = H.words(H.LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i])
                sets = H.shingles(h, first, shingle)
                keys = [set_key(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).slice(i, j - i), pa.array([int(k[0]) for k in keys], pa.int64()), pa.array([int(k[1]) for k in keys], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["label", "k1", "k2", "set"])

    source = docs.select(label(), "text").select("label", "text", b.alias("b"), F.xxhash64("text").alias("h"))
    sets = source.mapInArrow(run, "label long, k1 long, k2 long, set binary")
    # Several tasks may give the set: the node asks for one.
    return nodes.select("nid", "label", "k1", "k2").join(sets, ["label", "k1", "k2"]).groupBy("nid").agg(F.first("set").alias("set"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The set of ``a`` goes ahead of those it is compared with, once for about SPLIT of them, and is held while they stream by.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        first, x = None, None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, b, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                y = np.frombuffer(y.as_buffer(), np.uint64)
                if b is None:
                    first, x = a, y.copy()
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if a != first:
                    raise ValueError("a set is missing")
                if 100 * common >= percent * (len(both) - common):
                    found[0].append(a), found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    ahead = parts.join(sets.withColumnRenamed("nid", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set")
    behind = pairs.join(parts, "a").join(sets.withColumnRenamed("nid", "b"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "set")
    both = ahead.unionByName(behind).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return both.select("a", "b", "set").mapInArrow(run, "a long, b long")


def across(members: DataFrame, floor: float, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a bucket that may be similar; members: bucket, nid, comp, n, sketch.

    A bucket is its largest component and the others. The others, in blocks of about BLOCK members, meet each other and the blocks
    of the largest, which don't meet among themselves. Groups of two blocks are streamed in key order, so a task holds one.
    Only pairs that pass the size and signature tests leave it.
    """
    parts = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    size = parts.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    size = size.select("bucket", F.col("top.comp").alias("top"), blocks(F.col("top.c")).alias("nl"), blocks(F.col("c") - F.col("top.c")).alias("no"))
    m = members.join(size, "bucket").withColumn("large", F.col("comp") == F.col("top"))
    m = m.withColumn("i", F.pmod(F.xxhash64("nid"), F.when(F.col("large"), F.col("nl")).otherwise(F.col("no"))).cast("int"))
    group = lambda kind, g, h: F.struct(F.lit(kind).alias("kind"), g.cast("int").alias("g"), h.cast("int").alias("h"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    i = F.col("i")
    each = F.when(F.col("large"), F.transform(upto("no"), lambda x: group(1, x, i))).otherwise(
        F.concat(F.transform(upto("no"), lambda x: group(0, F.least(x, i), F.greatest(x, i))), F.transform(upto("nl"), lambda x: group(1, i, x))))
    m = m.withColumn("at", F.explode(each)).select("bucket", F.col("at.kind").alias("kind"), F.col("at.g").alias("g"), F.col("at.h").alias("h"), "nid", "comp", "n", "sketch", "large", "i")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def pairs(x, y, diagonal):
            unlike = np.zeros((len(x[0]), len(y[0])), np.uint16)
            for k in range(WORDS64):
                d = x[3][:, None, k] ^ y[3][None, :, k]
                unlike += np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555))
            chance = 2.0**-BITS
            most = np.floor((1.0 - chance - floor * (1.0 - chance)) * HASHES + 1e-9)
            ok = (unlike <= most) & (x[1][:, None] != y[1][None, :])
            ok &= 100 * np.minimum(x[2][:, None], y[2][None, :]) >= percent * np.maximum(x[2][:, None], y[2][None, :])
            if diagonal:
                ok &= x[0][:, None] < y[0][None, :]
            a, b = np.nonzero(ok)
            a, b = x[0][a], y[0][b]
            return np.minimum(a, b), np.maximum(a, b)

        def group(held, key):
            cols = [np.concatenate([r[k] for r in held]) for k in range(6)]
            _, kind, g, h = key
            if kind == 0 and g == h:
                return pairs(cols, cols, True)
            one = ~cols[4] if kind else cols[5] == g
            return pairs([c[one] for c in cols], [c[~one] for c in cols], False)

        def table(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)], names=["a", "b"])

        held, key = [], None
        for batch in batches:
            ks = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            if not len(ks):
                continue
            cut = [0, *(np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1), len(ks)]
            nid, comp, n, i = (batch.column(k).to_numpy() for k in (4, 5, 6, 9))
            sk, large = batch.column(7).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS64), batch.column(8).to_numpy(zero_copy_only=False)
            found = []
            for s, e in zip(cut[:-1], cut[1:]):
                k = tuple(ks[s])
                if held and k != key:
                    found.append(group(held, key))
                    held = []
                key = k
                held.append((nid[s:e], comp[s:e], n[s:e], sk[s:e], large[s:e], i[s:e]))
            if found:
                yield table(found)
        if held:
            yield table([group(held, key)])

    keys = ["bucket", "kind", "g", "h"]
    ordered = m.repartition(*keys).sortWithinPartitions(*keys).select("bucket", *[F.col(k).cast("long") for k in keys[1:]], "nid", "comp", "n", "sketch", "large", "i")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept (doc_id = component_id); a row per row of ``docs``.

    Words are runs of non-space bytes, A-Z lower-cased. Null and blank texts have an empty set and link with nothing:
    their component is their own. Equal sets are linked whatever their length. Rows of null doc_id link like others but name
    nothing: the component_id of a component that only they form is null and its rows are kept. Rows that repeat a doc_id are
    all kept or all not, each by its own text. Empty input gives no rows.
    """
    sigs = stage(signatures(docs, shingle), "signatures")
    full = sigs.where(F.col("k1").isNotNull())
    nodes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("name"), F.min("label").alias("other"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes.withColumn("label", F.coalesce("name", "other")).drop("other").withColumn("nid", F.monotonically_increasing_id()), "nodes")

    bands = nodes.select("nid", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("nid").alias("rep"), F.count("*").alias("c")).where("c > 1").select("bucket", "rep")
    members = stage(bands.join(shared, "bucket"), "buckets")

    floor = percent / 100 - SLACK
    sketches = nodes.select("nid", "n", "sketch")
    star = members.where("nid <> rep").select(F.col("rep").alias("a"), F.col("nid").alias("b")).distinct()
    star = star.join(sketches.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(
        sketches.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    star = star.withColumn("est", estimate("sa", "sb")).where((F.col("est") >= floor) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    # The best star of each member first; what it misses is tested across components below.
    first = stage(star.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b"), "stars")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
        return full_sets(docs, nodes.select("nid", "label", "k1", "k2").join(ids, "nid"), shingle)

    links = stage(confirm(first, sets_of(first), percent), "links")
    comp = stage(components(links), "components")
    where = members.select("bucket", "nid").join(comp.withColumnRenamed("node", "nid"), "nid", "left").select("bucket", "nid", F.coalesce("component", "nid").alias("comp"))
    mixed = where.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = where.join(mixed, "bucket").join(sketches, "nid")
    more = stage(across(rest, floor, percent).join(first, ["a", "b"], "left_anti"), "rest")
    if more.limit(1).count():
        extra = stage(confirm(more, sets_of(more), percent), "links")
        comp = stage(components(links.unionByName(extra)), "components")

    tagged = nodes.select("k1", "k2", "name", "nid").join(comp.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    named_by = tagged.groupBy("component").agg(F.min("name").alias("component_id"))
    final = tagged.join(named_by, "component").select("k1", "k2", "component_id")
    drop_staged(members, first)
    linked = full.select("doc_id", "n_shingles", "k1", "k2").join(final, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where(F.col("k1").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
c AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.d = w.doc_id
"""
