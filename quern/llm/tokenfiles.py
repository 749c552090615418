"""Token-id files: documents in ascending doc_id order, ids coded by range asymmetric numeral systems.

A file is ``segments``: a shared frequency table, then independent blocks. Blocks and segments end between
documents, so each decodes alone to whole documents. File layout, little-endian:

    segment  b"QTS1", n_symbols u32, symbols u32[], frequencies u32[], crc32 of these u32
    block    b"QTB1", n_docs u32, n_tokens u64, lanes u32, every u32, n_words u32, n_checkpoints u32,
             doc ids i64[], doc id nulls u8[], doc lengths u32[],
             checkpoint positions i64[], checkpoint states u64[][lanes], words u32[],
             crc32 of the decoded ids (u32 each) u32, crc32 of all before it in the block u32

Writers are tasks over ranges of doc_id. Each writes a file under a name of its own and moves it into place when it is
whole; the index, written by Spark's commit, names the files that count, so retried and speculative tasks leave no trace.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import drop_staged, stage, staged_path

END_ID, LANES, EVERY, BLOCK_TOKENS, SEGMENT_TOKENS, SALT = 2, 512, 128, 1 << 19, 1 << 22, 64


def file_system(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else "file://" + url)


def segment_bytes(docs: list[tuple[int | None, bytes]]) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """A segment of (doc_id, ids) and its blocks: (place in the segment, bytes, documents, tokens)."""
    import numpy as np

    from quern.llm import rans

    ids = np.frombuffer(b"".join(b for _, b in docs), "<u4")
    symbols, freq = rans.table(ids)
    head = struct.pack("<I", len(symbols)) + symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes()
    out = [b"QTS1" + head + struct.pack("<I", zlib.crc32(head))]
    size, blocks, at, i = len(out[0]), [], 0, 0
    lengths = [len(b) // 4 for _, b in docs]
    rank = np.zeros(int(symbols[-1]) + 1, np.int64)
    rank[symbols] = np.arange(len(symbols))
    while i < len(docs):
        j, n = i, 0
        while j < len(docs) and (n == 0 or n + lengths[j] <= BLOCK_TOKENS):
            n += lengths[j]
            j += 1
        part = ids[at : at + n]
        words, states, places = rans.encode(rank[part], freq, LANES, EVERY)
        own = [d for d, _ in docs[i:j]]
        body = b"".join((
            struct.pack("<IQIIII", j - i, n, LANES, EVERY, len(words), len(places)),
            np.array([d or 0 for d in own], "<i8").tobytes(), np.array([d is None for d in own], "u1").tobytes(), np.array(lengths[i:j], "<u4").tobytes(),
            places.astype("<i8").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(), struct.pack("<I", zlib.crc32(part.astype("<u4").tobytes()))))
        block = b"QTB1" + body + struct.pack("<I", zlib.crc32(body))
        blocks.append((size, len(block), j - i, n))
        out.append(block)
        size, at, i = size + len(block), at + n, j
    return b"".join(out), blocks


def read_table(data: bytes):
    import numpy as np

    if data[:4] != b"QTS1":
        raise ValueError("not a segment")
    n = struct.unpack_from("<I", data, 4)[0]
    if zlib.crc32(data[4 : 8 + 8 * n]) != struct.unpack_from("<I", data, 8 + 8 * n)[0]:
        raise ValueError("damaged frequency table")
    return np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, "<u4", n, 8 + 4 * n)


def read_block(data: bytes, symbols, freq, slot) -> tuple[list[int | None], list[int], bytes]:
    """(doc ids, lengths, all ids as little-endian u32) of a block; damage is an error."""
    import numpy as np

    from quern.llm import rans

    if data[:4] != b"QTB1" or zlib.crc32(data[4:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block")
    docs, n, lanes, every, n_words, marks = struct.unpack_from("<IQIIII", data, 4)
    at = 4 + struct.calcsize("<IQIIII")

    def take(kind: str, k: int):
        nonlocal at
        a = np.frombuffer(data, kind, k, at)
        at += a.nbytes
        return a

    own, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    places, states, words = take("<i8", marks), take("<u8", marks * lanes).reshape(marks, lanes), take("<u4", n_words)
    ids = symbols[rans.decode(words, states, places, freq, slot, n, lanes, every)].astype("<u4").tobytes()
    if zlib.crc32(ids) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("decoded ids differ from the checksum")
    return [None if z else int(d) for d, z in zip(own, nulls)], lengths.tolist(), ids


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to ``folder``; returns their index, one row per block (itself a table in the shared folder).

    Rows go by doc_id, null first, ties by a hash of the text. Null text is empty: the end id alone. Empty input: no files.
    Files are cut by (doc_id, text hash, salt), so rows that share a doc_id, or are the same, may go on in the next file.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from quern.llm.words import words

        enc, end, part = words(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        system, base = file_system(folder)
        name, f, size, rows = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.qtk", None, 0, []
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush():
            nonlocal f, size, tokens
            if f is None:
                system.create_dir(base, recursive=True)
                f = system.open_output_stream(f"{base}/.{name}")
            data, blocks = segment_bytes(held)
            f.write(data)
            rows.extend((part, name, size, size + at, n, d, t) for at, n, d, t in blocks)
            size += len(data)
            held.clear()
            tokens = 0

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.ids(text.as_py() or "") + end
                held.append((doc, ids))
                tokens += len(ids) // 4
                if tokens >= SEGMENT_TOKENS:
                    flush()
        if held:
            flush()
        if f is not None:
            f.close()
            system.move(f"{base}/.{name}", f"{base}/{name}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), *[pa.int64()] * 5))],
            names=["part", "file", "segment", "at", "n_bytes", "n_docs", "n_tokens"])

    keys = ["doc_id", "_hash", "_salt"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), (F.monotonically_increasing_id() % SALT).alias("_salt"))
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    index = ordered.select("doc_id", "text").mapInArrow(run, "part int, file string, segment long, at long, n_bytes long, n_docs long, n_tokens long")
    return stage(index, "index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian u32) of every document, a task per group of blocks."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per file
    base = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(base, F.lit(0)).cast("long").alias("_base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = index.withColumn("_in", F.coalesce(inside, F.lit(0)).cast("long")).join(parts, "part")
    blocks = blocks.select("file", "segment", "at", "n_bytes", (F.col("_base") + F.col("_in")).alias("start"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from quern.llm import rans

        system, base = file_system(folder)
        key, table = None, None
        for b in batches:
            for row in b.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as f:
                    if key != (row["file"], row["segment"]):
                        key = (row["file"], row["segment"])
                        n = struct.unpack("<I", f.read_at(4, row["segment"] + 4))[0]
                        symbols, freq = read_table(f.read_at(12 + 8 * n, row["segment"]))
                        table = (symbols, freq, rans.slots(freq))
                    docs, lengths, ids = read_block(f.read_at(row["n_bytes"], row["at"]), *table)
                starts, out, at = [], [], 0
                for n in lengths:
                    starts.append(row["start"] + at)
                    out.append(ids[4 * at : 4 * (at + n)])
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    # Blocks of one segment go to one task, which reads its table once. The index is small and the work is not: a given
    # number of tasks keeps adaptive execution from joining them by the index's bytes.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.repartition(tasks, "file", "segment").sortWithinPartitions("file", "at")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` and read the files back: doc_id, start, n_tokens, ids; one row per row of ``docs``."""
    folder = folder or staged_path(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, folder, end_id), folder)


__all__ = ["drop_staged", "read", "round_trip", "write"]
