"""Count-only Viterbi for a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic programming keeps, per
position, the best score and the number of pieces, no back pointers. Ties follow the ``tokenizers`` library's unigram
model: for one end, the earliest start (the longest piece) is met first and only a strictly better score replaces
it; a character without a piece of its own is unknown, at the lowest score less 10, and counts as its UTF-8 bytes.

A space starts a new word (written as U+2581) and pieces never cross words, so a text's count is the sum over its
words; each worker keeps a bounded cache from word to (pieces, score).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import worker_cache

SPACE = "▁"
WORDS = re.compile(f"{SPACE}[^{SPACE}]*")
CACHE_WORDS = 300_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter(dict):
    """word -> (number of pieces, score)."""

    def __init__(self, vocab: list[tuple[str, float]], limit: int = CACHE_WORDS):
        import ahocorasick

        super().__init__()
        self.automaton, self.limit, self.old = ahocorasick.Automaton(), limit, {}
        for piece, score in dict(vocab).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - 10.0

    def count(self, word: str) -> tuple[int, float]:
        best, pieces, at = [0.0], [0], 0
        low = float("-inf")
        ends: list[list] = [[] for _ in word]
        for end, match in self.automaton.iter(word):  # the longest first for each end
            ends[end].append(match)
        for at, matches in enumerate(ends):
            top, n = low, 0
            for length, score in matches:
                start = at + 1 - length
                if (s := best[start] + score) > top:
                    top, n = s, pieces[start] + 1
            if (not matches or matches[-1][0] > 1) and (s := best[at] + self.unknown) > top:
                top, n = s, pieces[at] + len(word[at].encode("utf-8", "surrogatepass"))
            best.append(top)
            pieces.append(n)
        return pieces[-1], best[-1]

    def __missing__(self, word: str) -> tuple[int, float]:
        got = self.old.get(word) or self.count(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        found = map(self.__getitem__, WORDS.findall(text if text[0] == SPACE else SPACE + text))
        n, score = zip(*found)
        return sum(n), float(sum(score))


def counter(path: str) -> Counter:
    return worker_cache(f"unigram {path}", lambda: Counter(vocabulary(path)))


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """Columns doc_id, n_tokens, score; one row per row of ``docs``, in one pass and without a shuffle.

    Null and empty texts have no tokens and score 0. Texts of any length are taken whole; doc_id is passed on as it
    is, null or repeated. Empty input gives no rows; other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = counter(model)
        for b in batches:
            got = [c.text(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
