"""Removal of every byte covered by a window of fixed length that starts at another place of the corpus too.

A window is a number of symbols: bytes (BYTES, the contract of op8), or whole words whatever space is between them
(WORDS, which every passage of over 50 words reaches). Equal windows are brought together by content: a window is owned
by its anchor, the leftmost of its k-symbol strings of lowest hash, so equal windows have equal anchors at equal distances. Consecutive windows with one
anchor are a run. Runs whose whole region (all their windows' bytes) occurs twice are repeated outright. Anchors with
several different regions are decided by suffix arrays: each region is a sequence of blocks of symbols on a grid fixed to
the anchor, a bucket's sequences are sorted by the linear Lyndon grouping of ``suffixarray``, and suffixes that share
as many blocks as lie whole in any window, which any two equal windows do, are one interval of the array. Only inside an interval are the windows
themselves compared, by 64-bit hashes of all their symbols. Texts are never cut, and matches never cross texts.

Anchors with more than HOT different regions don't fit a task's suffix array: their windows are counted by hash in a
grouped aggregation, combined before the shuffle, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop_staged, stage, worker_cache

SIZE, HOT, BITMAP = 400, 2000, 1 << 22


@dataclass(frozen=True)
class Window:
    """``size`` symbols, anchors of ``k`` and blocks of ``block`` symbols; symbols are bytes or, with ``words``, words."""

    size: int
    k: int
    block: int
    words: bool = False

    @property
    def reach(self) -> int:
        """Most symbols of a window before its anchor."""
        return self.size - self.k

    @property
    def blocks(self) -> int:
        return (2 * self.reach + self.k) // self.block

    @property
    def whole(self) -> int:
        """Blocks that lie wholly inside any window."""
        return (self.size - self.block + 1) // self.block

    @property
    def least(self) -> int:
        """Fewest bytes of a text that has a window: a word and the space before the next are two at least."""
        return 2 * self.size - 1 if self.words else self.size


BYTES, WORDS = Window(SIZE, 32, 48), Window(51, 5, 6, words=True)


def symbols(data, offs, window: Window):
    """(symbols, offsets of the texts among them, first byte and end of each symbol) of texts at ``offs``; for bytes the last two are None."""
    from quern.llm import hashing as H

    if not window.words:
        return data, offs, None, None
    start, end, h, first = H.words(data, offs)
    return h, first, start, end


def prefix(x):
    """As hashing.prefix, of bytes or of words' hashes."""
    import numpy as np

    from quern.llm import hashing as H

    if x.dtype == np.uint8:
        return H.prefix(x)
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * H.powers(len(x) + 1)[0][: len(x)], out=c[1:])
    return c


def runs(data, offs, window: Window):
    """(text, first window, number of windows, anchor, anchor hash, region hash) of each run of texts at ``offs``, in symbols."""
    import numpy as np

    from quern.llm import hashing as H

    U, n, SIZE, K = np.uint64, len(data), window.size, window.k
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 2
    if n < SIZE:
        return none
    c = prefix(data)
    width = SIZE - K + 1
    h = H.mix(H.spans(c, np.arange(n - K + 1), np.arange(K, n + 1)))
    key = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    rows = np.concatenate((key, np.full(-len(key) % width, np.iinfo(U).max, U))).reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(down[: len(key) - width + 1], up[width - 1 : len(key)]) & U(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    i = np.flatnonzero(np.arange(len(anchor)) + SIZE <= offs[text + 1])
    if not len(i):
        return none
    a, t = anchor[i], text[i]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (t[1:] != t[:-1]))))
    lo, hi, p, t = i[first], i[np.concatenate((first[1:], [len(i)])) - 1], a[first], t[first]
    region = H.mix(H.spans(c, lo, hi + SIZE) + H.mix(((p - lo) * 1024 + (hi - lo)).astype(U)))
    return t, lo, hi - lo + 1, p, h[p], region


def text_runs(docs: DataFrame, window: Window) -> DataFrame:
    """t (the text's md5), s and z (the region's first byte and size in bytes), n, off (anchor - first window, in symbols), a, r:
    the runs of every row's text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from quern.llm import hashing as H

        worker_cache("suffix", lambda: True)
        for b in batches:
            data, offs = H.text_bytes(b.column(1))
            for i, j in H.slices(offs):
                x, at, start, end = symbols(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window)
                t, lo, n, p, a, r = runs(x, at, window)
                first, last = lo, lo + n - 1 + window.size
                if window.words:
                    first, last = start[lo], end[last - 1]
                base = (offs[i:j] - offs[i])[t]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(t + i)), *(pa.array(v.astype(np.int32)) for v in (first - base, last - first, n, p - lo)), pa.array(a.view(np.int64)), pa.array(r.view(np.int64))],
                    names=["t", "s", "z", "n", "off", "a", "r"])

    long = docs.where(F.octet_length("text") >= window.least).select(F.unhex(F.md5("text")).alias("t"), "text")
    return long.mapInArrow(run, "t binary, s int, z int, n int, off int, a long, r long")


def shared_windows(regions: list, n, off, buckets: list[tuple[int, int]], window: Window):
    """Per region a boolean per window: does it equal a window, at the same distance from its anchor, of another region
    of its bucket? ``buckets`` are ranges of regions; all arrays are numpy, regions of symbols."""
    import numpy as np

    from quern.llm import hashing as H
    from quern.llm.suffixarray import suffix_array

    U = np.uint64
    SIZE, BLOCK, REACH, BLOCKS, WHOLE = window.size, window.block, window.reach, window.blocks, window.whole
    flags = [np.zeros(int(k), bool) for k in n]
    size = np.array([len(x) for x in regions])
    begin = np.concatenate(([0], np.cumsum(size)))
    data = np.concatenate(regions)
    c = prefix(data)
    # Blocks on the grid of each region: from anchor - REACH on; one that sticks out of its region is unlike any other.
    grid = begin[:-1, None] + np.asarray(off)[:, None] - REACH + BLOCK * np.arange(BLOCKS)[None, :]
    whole = (grid >= begin[:-1, None]) & (grid + BLOCK <= begin[1:, None])
    g = np.where(whole, grid, 0)
    names = H.mix(H.spans(c, g, g + BLOCK) + (np.arange(BLOCKS, dtype=U) * H.P)[None, :])
    names[~whole] = H.mix(np.flatnonzero(~whole.ravel()).astype(U) + U(1 << 40))
    starts = np.arange(BLOCKS - WHOLE + 1)
    ask = []  # (region, block, interval)
    interval = 0
    for x, y in buckets:
        _, rank = np.unique(names[x:y].ravel(), return_inverse=True)
        seq = np.zeros((y - x, BLOCKS + 1), np.int64)
        seq[:, :BLOCKS] = rank.reshape(y - x, BLOCKS) + 1  # 0 ends each region
        flat = seq.ravel()
        sa = np.array(suffix_array(flat.tolist()))
        sa = sa[(sa % (BLOCKS + 1)) <= starts[-1]]
        heads = flat[sa[:, None] + np.arange(WHOLE)[None, :]]
        same = (heads[1:] == heads[:-1]).all(axis=1)
        group = interval + np.concatenate(([0], np.cumsum(~same)))
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        ask.append(np.stack((x + sa[many] // (BLOCKS + 1), sa[many] % (BLOCKS + 1), group[many])))
        interval = int(group[-1]) + 1
    region, block, group = np.concatenate(ask, axis=1)
    if not len(region):
        return flags
    # The windows whose first whole block is this one: they start in the BLOCK symbols up to it.
    step = np.arange(-BLOCK + 1, 1)
    at = block[:, None] * BLOCK + step[None, :] - REACH + np.asarray(off)[region][:, None]  # first symbol within the region
    fine = (at >= 0) & (at < np.asarray(n)[region][:, None])
    row, col = np.nonzero(fine)
    where = at[row, col]
    s = begin[region[row]] + where
    key = H.mix(H.spans(c, s, s + SIZE) + H.mix((group[row] * BLOCK + col).astype(U)))
    _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[inv] > 1
    for r, w in zip(region[row[hit]].tolist(), where[hit].tolist()):
        flags[r][w] = True
    return flags


def bounds(flags):
    """Runs of true as (first, end)."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def region_symbols(x, window: Window):
    """(symbols, first byte and end of each) of a region's bytes."""
    import numpy as np

    data = np.frombuffer(x.as_buffer(), np.uint8)
    syms, _, start, end = symbols(data, np.array([0, len(data)]), window)
    return (syms, start, end) if window.words else (syms, np.arange(len(data)), np.arange(1, len(data) + 1))


def decide(regions: DataFrame, window: Window) -> DataFrame:
    """a, r, first, end: bytes of each region that its repeated windows cover, from a, r, n, off, bytes of all regions of an anchor."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def flush(rows):
            cut = [0, *[k for k in range(1, len(rows)) if rows[k][0] != rows[k - 1][0]], len(rows)]
            syms = [region_symbols(r[4], window) for r in rows]
            flags = shared_windows([x[0] for x in syms], [r[2] for r in rows], [r[3] for r in rows], list(zip(cut[:-1], cut[1:])), window)
            a, r, first, end = [], [], [], []
            for row, f, (_, begins, ends) in zip(rows, flags, syms):
                for x, y in zip(*bounds(f)):
                    a.append(row[0]), r.append(row[1]), first.append(int(begins[x])), end.append(int(ends[y - 2 + window.size]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["a", "r", "first", "end"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            for a, r, n, off, x in zip(*cols, b.column(4)):
                if len(held) >= 1024 and held[-1][0] != a:
                    yield flush(held)
                    held = []
                held.append((a, r, n, off, x))
        if held:
            yield flush(held)

    return regions.repartition("a").sortWithinPartitions("a", "r").select("a", "r", "n", "off", "bytes").mapInArrow(run, "a long, r long, first int, end int")


def count_windows(regions: DataFrame, window: Window) -> DataFrame:
    """As ``decide``, for anchors of very many regions: counts windows by hash, combined before the shuffle."""

    def explode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from quern.llm import hashing as H

        for b in batches:
            for a, r, n, off, x in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                syms, begins, ends = region_symbols(x, window)
                c = prefix(syms)
                w = np.arange(n)
                key = H.mix(H.spans(c, w, w + window.size) + H.mix((off - w + np.int64(1 << 20)).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, a)), pa.array(np.full(n, r)), pa.array(begins[w].astype(np.int32)), pa.array(ends[w + window.size - 1].astype(np.int32)), pa.array(key.view(np.int64))],
                    names=["a", "r", "first", "end", "k"])

    windows = regions.select("a", "r", "n", "off", "bytes").mapInArrow(explode, "a long, r long, first int, end int, k long")
    twice = windows.groupBy("a", "k").agg(F.count("*").alias("c")).where("c > 1").select("a", "k")
    return windows.join(twice, ["a", "k"]).select("a", "r", "first", "end")


def marks(docs: DataFrame, window: Window = BYTES) -> DataFrame:
    """t (a text's md5) and spans (array of start, end): bytes to remove; texts without any are left out. A staged table."""
    found = stage(text_runs(docs, window), "runs")
    classes = found.groupBy("a", "r").agg(F.count("*").alias("c"), F.min(F.struct("t", "s", "z", "n", "off")).alias("own"))
    anchors = found.groupBy("a").agg(F.count("*").alias("s")).where("s > 1").select("a")
    classes = stage(classes.join(anchors, "a"), "classes")
    sizes = classes.groupBy("a").agg(F.count("*").alias("k")).where("k > 1")
    full = found.join(classes.where("c > 1").select("a", "r"), ["a", "r"]).select("t", "s", (F.col("s") + F.col("z")).alias("e"))

    # The bytes of one region per class, from the text that owns it.
    owners = classes.join(sizes, "a").select("a", "r", "k", "own.*").groupBy("t").agg(F.collect_list(F.struct("a", "r", "k", "s", "z", "n", "off")).alias("ask"))
    t = F.unhex(F.md5("text"))
    long = docs.where(F.octet_length("text") >= window.least).select(t.alias("t"), "text")
    owning = only(long, owners, "t").groupBy("t").agg(F.first("text").alias("text"))

    asked = owning.join(owners, "t").select(F.col("text").cast("binary").alias("b"), F.explode("ask").alias("q"))
    regions = stage(asked.select("q.a", "q.r", "q.k", "q.n", "q.off", F.col("b").substr(F.col("q.s") + 1, F.col("q.z")).alias("bytes")), "regions")
    some = decide(regions.where(F.col("k") <= HOT), window).unionByName(count_windows(regions.where(F.col("k") > HOT), window))
    # Regions of a class that is repeated outright are marked already.
    once = classes.where("c = 1").select("a", "r", "own.t", "own.s")
    part = some.join(once, ["a", "r"]).select("t", (F.col("s") + F.col("first")).alias("s"), (F.col("s") + F.col("end")).alias("e"))
    spans = stage(full.unionByName(part).groupBy("t").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    drop_staged(found, classes, regions)
    return spans


def only(texts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``texts`` whose key is probably in ``wanted``, by a bitmap of constant size; a join must follow."""
    b = F.pmod(F.xxhash64(key), F.lit(BITMAP))
    rows = wanted.select(b.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    small = F.broadcast(rows)  # at most BITMAP / 32768 + 1 rows of 4 KB
    at = F.bitmap_bit_position("_b")
    hit = texts.withColumn("_b", b).withColumn("_k", F.bitmap_bucket_number("_b")).join(small.withColumnRenamed("k", "_k"), "_k")
    byte = F.conv(F.hex(F.col("m").substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return hit.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*texts.columns)


def removed(spans, n: int) -> list[tuple[int, int]]:
    """Maximal disjoint spans in order; touching ones are one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, min(e, n)) for s, e in out]


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), as_text: bool = False, window: Window = BYTES) -> DataFrame:
    """Columns doc_id, those of ``keep``, n_bytes, n_removed, n_spans, spans (array of start, end) and rest (the bytes that
    stay, binary); one row per row of ``docs``.

    Null text is empty. Texts of no whole window lose nothing. A text that occurs twice and has one loses all its bytes (all its
    words, and the space between them), in every row; rows with a null or repeated doc_id are texts like others. A repeat inside one text counts.
    What stays may end in the middle of a character: it is bytes, or with ``as_text`` a string without such halves.
    Empty input gives no rows.
    """
    names = ["doc_id", *keep]
    spans = marks(docs, window)
    text = F.coalesce(F.col("text"), F.lit(""))
    # Texts without a window have no marks: a key of their own each keeps them from meeting in one task.
    key = F.when(F.octet_length(text) >= window.least, F.unhex(F.md5(text))).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.cast("binary").alias("_b"), key.alias("t"))
    joined = rows.join(spans, "t", "left").select(*names, "_b", "spans")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for b in batches:
            size, gone, cuts, rest = [], [], [], []
            for x, marked in zip(b.column(len(names)), b.column(len(names) + 1)):
                x, marked = x.as_py(), marked.as_py() or []
                cut = removed([(m["s"], m["e"]) for m in marked], len(x))
                size.append(len(x)), cuts.append([{"s": s, "e": e} for s, e in cut]), gone.append(sum(e - s for s, e in cut))
                ends = [0, *[k for c in cut for k in c], len(x)]
                left = b"".join(x[s:e] for s, e in zip(ends[::2], ends[1::2]))
                rest.append(left.decode("utf-8", "ignore") if as_text else left)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(names))], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(cuts, span), pa.array(rest, pa.string() if as_text else pa.binary())],
                names=[*names, "n_bytes", "n_removed", "n_spans", "spans", "rest"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(names)])
    return joined.mapInArrow(run, f"{fields}, n_bytes long, n_removed long, n_spans long, spans array<struct<s:int,e:int>>, rest {'string' if as_text else 'binary'}")


def brute_force(texts: list[str | None], size: int = SIZE) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, sha256 of the rest for each text, from a table of all windows."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for x in data:
        for i in range(len(x) - size + 1):
            w = x[i : i + size]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for x in data:
        cut = removed([(i, i + size) for i in range(len(x) - size + 1) if seen[x[i : i + size]] > 1], len(x))
        ends = [0, *[k for c in cut for k in c], len(x)]
        rest = b"".join(x[s:e] for s, e in zip(ends[::2], ends[1::2]))
        out.append((len(x), sum(e - s for s, e in cut), len(cut), hashlib.sha256(rest).hexdigest()))
    return out


def brute_force_words(texts: list[str | None], size: int = WORDS.size) -> list[list[tuple[int, int]]]:
    """The spans of bytes to remove of each text, from a table of all runs of ``size`` words."""
    import re

    found = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    seen: dict[tuple, int] = {}
    for w in found:
        for i in range(len(w) - size + 1):
            k = tuple(x[2] for x in w[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    return [removed([(w[i][0], w[i + size - 1][1]) for i in range(len(w) - size + 1) if seen[tuple(x[2] for x in w[i : i + size])] > 1], len((t or "").encode())) for t, w in zip(texts, found)]


__all__ = ["BYTES", "WORDS", "Window", "brute_force", "brute_force_words", "dedup", "drop_staged", "marks"]
