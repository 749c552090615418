"""Best-two-fit packing of tokenised documents into sequences.

Lengths are integers up to the sequence length, so the packing is decided on their histogram, a table whose size
is a parameter: a bin is filled greedily with the longest piece that fits, then its smallest piece is replaced by
two unpacked ones that fill the widened gap more tightly; the pattern found repeats for as many bins as the
histogram holds. Every piece then finds its place by its exact rank among the pieces of its length. Ranks are
local ranks plus offsets per partition, so no piece moves and no task sees more than its own partition.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stage

MAX_TOKENS, END_ID, BROADCAST_ROWS = 1024, 2, 200_000


def best_two_fit(counts: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces per length in a bin, number of bins) that use up ``counts`` (pieces per length)."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        used: Counter[int] = Counter()
        gap, i = cap, len(lengths)
        while True:
            i = min(i, bisect_right(lengths, gap))
            while i and left[lengths[i - 1]] - used[lengths[i - 1]] <= 0:
                i -= 1
            if not i:
                break
            used[lengths[i - 1]] += 1
            gap -= lengths[i - 1]
        small = min(used)
        if gap and (pair := tightest_pair(lengths, left, used, small, gap + small)):
            used[small] -= 1
            used.update(pair)
            used += Counter()
        bins = min(left[k] // n for k, n in used.items())
        out.append((dict(used), bins))
        for k, n in used.items():
            left[k] -= n * bins
        lengths = [k for k in lengths if left[k]]
    return out


def tightest_pair(lengths: list[int], left: dict[int, int], used: Counter, small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths of the largest sum in (small, room]."""
    free = [k for k in lengths[: bisect_right(lengths, room)] if left[k] > used[k]]
    best, pair, i, j = small, None, 0, len(free) - 1
    while i <= j:
        s = free[i] + free[j]
        if s > room:
            j -= 1
            continue
        if s > best and (i < j or left[free[i]] - used[free[i]] > 1):
            best, pair = s, (free[i], free[j])
            if s == room:
                break
        i += 1
    return pair


def plan(counts: dict[int, int], cap: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces of that length per bin, place of the first), by length and rank."""
    runs, seen, base = [], Counter(), 0
    for pattern, bins in best_two_fit(counts, cap):
        at = 0
        for k in sorted(pattern, reverse=True):
            runs.append((k, seen[k], base, pattern[k], at))
            seen[k] += pattern[k] * bins
            at += pattern[k] * k
        base += bins
    return sorted(runs)


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and the piece's rank in its partition."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from quern.llm.words import words

        enc, end, pid = words(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (max_tokens + 1)
        cols: list[list] = [[] for _ in range(6)]

        def flush():
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array([pid] * len(cols[0]), pa.int32())]
            out = pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids", "_local", "_pid"])
            for c in cols:
                c.clear()
            return out

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(text.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                take = n % max_tokens or max_tokens
                while at < n:
                    for c, x in zip(cols, (doc, k, at, take, ids[4 * at : 4 * (at + take)], seen[take])):
                        c.append(x)
                    seen[take] += 1
                    at, k, take = at + take, k + 1, max_tokens
                held += len(ids)
                if held > 4 << 20:
                    yield flush()
                    held = 0
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary, _local long, _pid int")


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, payload: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, sequence_id, offset and ``payload`` (the ids, if none is given).

    Null text is empty: its document is the end id alone. Documents longer than a sequence are cut into full
    pieces after a first one that may be shorter; all others stay whole. doc_id may be null or repeat: rows are
    documents of their own. Empty input gives no rows; other columns are ignored. Sequences are numbered from 0.
    """
    cut = stage(pieces(docs, tokenizer, max_tokens, end_id), "pieces")
    per = stage(cut.groupBy("_pid", "length").agg(F.count("*").alias("_n")), "lengths")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("_pid", "length", F.coalesce(before, F.lit(0)).cast("long").alias("_before"))
    counts = {k: n for k, n in per.groupBy("length").agg(F.sum("_n")).collect()}  # at most max_tokens rows
    runs = plan(counts, max_tokens)
    # A row per partition and length: sent to all tasks while small, else joined by shuffle.
    if per.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    payload = F.col("ids") if payload is None else payload
    ranked = cut.select("doc_id", "piece", "start", "length", payload, "_pid", "_local").join(offsets, ["_pid", "length"])
    name = [c for c in ranked.columns if c not in ("doc_id", "piece", "start", "length", "_pid", "_local", "_before")][0]
    kind = ranked.schema[name].dataType.simpleString()

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not runs:
            return
        length, first, base, each, at = (np.array(x, dtype=np.int64) for x in zip(*runs))
        keys = (length << 44) + first
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            run = np.searchsorted(keys, (n << 44) + r, side="right") - 1
            j = r - first[run]
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", name)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(base[run] + j // each[run]), pa.array(at[run] + j % each[run] * n)],
                names=["doc_id", "piece", "start", "length", name, "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", name, (F.col("_before") + F.col("_local")).alias("_rank"))
    return ranked.mapInArrow(place, f"doc_id long, piece int, start long, length long, {name} {kind}, sequence_id long, offset long")
