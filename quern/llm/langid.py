"""Language identification by compression.

Per language, a raw-content zstandard dictionary is made of a bounded sample of labelled texts, each of them whole. A text is encoded
whole, in blocks, once with every dictionary; the language whose dictionary gives the fewest bytes wins, and the
text is rejected when the runner-up comes too close. Letters are lower-cased and all other ASCII becomes single
spaces before encoding; a few zero bytes end each block, so that even the shortest text is stored as matches and
literals and not as a raw block, which would cost the same in every language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import drop_staged, stage, worker_cache

#: Bounds of the fit: texts per language and bytes of a dictionary; beyond so many languages all share what these would have. Least bytes of a segment.
SAMPLE_TEXTS, DICT_BYTES, MAX_LANGUAGES, SEGMENT = 400, 112 << 10, 64, 40
#: Bytes of text encoded at once, compression level, shortest match, and the least lead (as a share) of an accepted text.
BLOCK, LEVEL, MATCH, MARGIN = 2048, 3, 3, 0.01
FILLER = bytes(32)
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
UNKNOWN = "und"


def is_training(doc_id: Column) -> Column:
    """Whether the crc32 of doc_id as text leaves another remainder than 1 by 3; a null doc_id leaves none and is one to learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split())


def content(texts: list[bytes], size: int, width: int = SEGMENT) -> bytes:
    """A dictionary of at most ``size`` bytes from whole normalised texts: the segments that cover most.

    A segment is worth the counts over all texts of its words, a byte; each time that the dictionary takes a word its count
    halves. The best segments come last, where matches are cheapest.
    """
    import heapq

    segments: dict[bytes, None] = {}
    for t in texts:
        at = 0
        while at < len(t):
            end = t.find(b" ", at + width)
            end = len(t) if end < 0 else end
            segments[t[at:end]] = None
            at = end + 1
    words = [(x, set(x.split())) for x in segments]
    left = Counter(w for _, own in words for w in own)
    heap = [(-sum(left[w] for w in own) / (len(x) + 1), x, own) for x, own in words]
    heapq.heapify(heap)
    out, room = [], size
    while heap and room > 0:
        _, x, own = heapq.heappop(heap)
        now = -sum(left[w] for w in own) / (len(x) + 1)
        if heap and now > heap[0][0]:  # worth less than it was: it waits
            heapq.heappush(heap, (now, x, own))
            continue
        out.append(x[:room])
        room -= len(x) + 1
        for w in own:
            left[w] /= 2
    return b" ".join(out[::-1])


def fit(labelled: DataFrame, texts: int = SAMPLE_TEXTS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """lang -> dictionary content, from ``labelled`` (doc_id, text, lang; rows with null text or lang are left out).

    Per language, the ``texts`` different rows of lowest hash of (doc_id, text) are taken, whole: a top-k of hashes per language,
    then a second pass for these texts alone. A task per language makes its dictionary (``content``), so only
    ``dict_bytes`` a language come to the driver. More than MAX_LANGUAGES languages have fewer texts and smaller
    dictionaries each, one text at least. No rows: no languages.
    """
    given = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    order = Window.partitionBy("lang").orderBy("h")
    first = given.select("lang", "h").withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= texts).groupBy("lang", "h").agg(F.min("k").alias("k"))
    first = stage(first, "sample")
    many = max(1, first.select("lang").distinct().count() / MAX_LANGUAGES)
    texts, dict_bytes = max(1, int(texts / many)), max(SEGMENT, int(dict_bytes / many))
    some = F.broadcast(first.where(F.col("k") <= texts).select("lang", "h"))  # texts * languages rows, parameters
    whole = given.join(some, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def build(key, table):
        import pyarrow as pa

        rows = sorted(zip(table.column("h").to_pylist(), table.column("text").to_pylist()))
        return pa.table({"lang": [key[0].as_py()], "content": pa.array([content([normal(t) for _, t in rows], dict_bytes)], pa.binary())})

    made = whole.groupBy("lang").applyInArrow(build, "lang string, content binary").collect()
    drop_staged(first)
    return {r.lang: bytes(r.content) for r in made}


class Model:
    def __init__(self, contents: dict[str, bytes], block: int = BLOCK, level: int = LEVEL):
        import zstandard as z

        self.block, self.langs = block, sorted(contents)
        params = z.ZstdCompressionParameters.from_level(level, min_match=MATCH, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(contents[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + self.block] + FILLER for i in range(0, len(text), self.block)]
        return [sum(len(f(b)) for b in blocks) for f in self.by]


def predict(docs: DataFrame, contents: dict[str, bytes], margin: float = MARGIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, lang_pred, score, margin, accepted and those of ``keep``; one row per row of ``docs``.

    ``und`` with score 0, not accepted: null text, a text without a letter, or no languages at all. Ties go to the
    language first in code-point order, with margin 0, not accepted. With one language there is no runner-up: margin 1.
    score is 1 - the winner's bytes over the average of all languages', at least 0. ``lang`` is never read.
    """
    names = list(dict.fromkeys(["doc_id", *keep]))
    inputs = names if "text" in names else [*names, "text"]
    key = hash(tuple(sorted(contents.items())))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = worker_cache(f"language {key}", lambda: Model(contents))
        for b in batches:
            lang, score, lead = [], [], []
            for text in b.column(inputs.index("text")):
                t = text.as_py()
                if not m.langs or t is None or not any(map(str.isalpha, t)):
                    lang.append(UNKNOWN), score.append(0.0), lead.append(0.0)
                    continue
                sizes = m.sizes(normal(t))
                first, *others = sorted(zip(sizes, m.langs))
                lang.append(first[1])
                lead.append((others[0][0] - first[0]) / others[0][0] if others else 1.0)
                score.append(min(1.0, max(0.0, 1 - first[0] * len(sizes) / sum(sizes))) if others else 1.0)
            cols = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64()), pa.array([x > margin for x in lead], pa.bool_())],
                names=[*names, "lang_pred", "score", "margin", "accepted"])

    source = docs.select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in inputs])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(names)])
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double, margin double, accepted boolean")


def identify(docs: DataFrame, margin: float = MARGIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fit on the training part of ``docs`` (is_training, lang given), then predict every row of it."""
    return predict(docs, fit(docs.where(is_training(F.col("doc_id")))), margin, keep)
