"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``slots`` equal arcs. Every shard owns ``vnodes`` points on it; a slot belongs to the next point
clockwise. A key starts at the slot of its hash. Loads are bounded by exact capacities (counts that differ by
one at most), so the law is ``rows``: each shard keeps its own keys in ring order up to its capacity, and keys
overflowing a full shard continue clockwise to the next point whose shard has room.

Only the number of keys per slot decides where a run of keys goes, so the walk around the ring is done on at
most ``slots`` counters, a bound that is a parameter and doesn't grow with the data. Rows then meet their run
by (slot, rank in the slot): ranks come from balanced ranges of ring order, by one rule at every size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import drop_staged, stage

SLOTS, VNODES, SALT, BROADCAST_ROWS = 4096, 64, 64, 200_000


def ring(shards: int, vnodes: int = VNODES, slots: int = SLOTS) -> list[int]:
    """The shard of each slot. Points are placed in order of shards, a taken slot's in the next free one, so each shard has
    all its points and one more shard only adds points."""
    if shards * vnodes > slots:
        raise ValueError(f"{shards} x {vnodes} points don't fit {slots} slots")
    owner: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.md5(f"shard {s} point {v}".encode()).digest()[:8], "big") % slots
            while at in owner:
                at = (at + 1) % slots
            owner[at] = s
    out, last = [0] * slots, owner[min(owner)]
    for i in range(slots - 1, -1, -1):
        last = owner.get(i, last)
        out[i] = last
    return out


def spread(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (slot, first rank, end rank, shard, first place in the shard) for ``counts`` keys per slot."""
    total, slots = sum(counts), len(owners)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    load, runs, over = [0] * shards, [], []

    def give(slot: int, first: int, n: int, s: int) -> int:
        take = min(n, room[s] - load[s])
        if take:
            runs.append((slot, first, first + take, s, load[s]))
            load[s] += take
        return take

    for slot, n in enumerate(counts):
        kept = give(slot, 0, n, owners[slot])
        if kept < n:
            over.append((slot, kept, n))
    for slot, first, end in over:
        step = 0
        while first < end:
            step += 1
            s = owners[(slot + step) % slots]
            if load[s] < room[s]:
                first += give(slot, first, end - first, s)
    return runs


def shard(docs: DataFrame, shards: int = 8, vnodes: int = VNODES, slots: int = SLOTS) -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of ``docs``.

    Null text counts as empty (size 1, crc32 0). A null doc_id starts at the slot of its text's crc32. Rows that
    are equal in all of this take places next to each other in any order. Empty input gives no rows; other
    columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    owners = ring(shards, vnodes, slots)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("_b")).select(
        "doc_id", (F.octet_length("_b") + F.lit(1)).cast("long").alias("size"), F.crc32("_b").alias("text_crc32"))
    keyed = keyed.withColumn("_pos", F.xxhash64(F.coalesce("doc_id", "text_crc32")))
    keyed = stage(keyed.withColumn("_slot", F.pmod(F.shiftrightunsigned("_pos", 20), F.lit(slots)).cast("int")), "keys")

    # Ranges of ring order are balanced by rows, and a salt is the last key: neither a hot slot nor a row that is
    # repeated very often fills one task. A row's rank in its slot is its place in its range plus the counts before.
    order = ["_slot", "_pos", "doc_id", "text_crc32", "size", "_salt"]
    salted = keyed.withColumn("_salt", F.monotonically_increasing_id() % SALT)
    ordered = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt", "_pos").withColumn("_at", F.monotonically_increasing_id())
    ordered = stage(ordered, "ring")  # _at is (range, place) from here on
    drop_staged(keyed)
    pid = F.shiftright("_at", 33)
    spans = ordered.groupBy("_slot", pid.alias("_pid")).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    spans = stage(spans, "spans")  # at most a row per slot and one more per range
    before = F.sum("_n").over(Window.partitionBy("_slot").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.select("_slot", "_pid", "_from", F.coalesce(before, F.lit(0)).cast("long").alias("_before"))

    counts = [0] * slots
    for slot, k in spans.groupBy("_slot").agg(F.sum("_n")).collect():  # at most `slots` rows
        counts[slot] = k
    runs = spread(counts, owners, shards)
    table = ", ".join(f"({a}, {b}L, {c}L, {d}, {e}L)" for a, b, c, d, e in runs) or "(-1, 0L, 0L, 0, 0L)"
    # At most (shards + 1) * slots runs, whatever the data: safe to broadcast.
    moves = F.broadcast(spark.sql(f"SELECT * FROM VALUES {table} AS t(_slot, _first, _end, shard, _base)"))
    if spans.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = ordered.withColumn("_pid", pid).join(offsets, ["_slot", "_pid"]).withColumn("_rank", F.col("_at") - F.col("_from") + F.col("_before"))
    placed = ranked.join(moves, "_slot").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_base") + F.col("_rank") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def brute_force(rows: list[tuple[int | None, str | None]], keys, shards: int = 8, vnodes: int = VNODES, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(shard, slot) of each (doc_id, text): every key walks the ring on its own; ``keys`` are the positions of the rows."""
    import zlib

    owners = ring(shards, vnodes, slots)
    order = sorted(range(len(rows)), key=lambda i: ((keys[i] >> 20) % slots if keys[i] >= 0 else ((keys[i] + (1 << 64)) >> 20) % slots, keys[i],
                                                    rows[i][0] is not None, rows[i][0] or 0, zlib.crc32((rows[i][1] or "").encode())))
    start = {i: ((keys[i] % (1 << 64)) >> 20) % slots for i in order}
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    load, out, over = [0] * shards, [(-1, -1)] * len(rows), []
    for i in order:  # a shard keeps its own keys first
        s = owners[start[i]]
        if load[s] < room[s]:
            out[i] = (s, load[s])
            load[s] += 1
        else:
            over.append(i)
    for i in over:  # then keys that found it full go on clockwise
        at = start[i]
        while load[owners[at % slots]] >= room[owners[at % slots]]:
            at += 1
        s = owners[at % slots]
        out[i] = (s, load[s])
        load[s] += 1
    return out
