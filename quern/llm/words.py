"""Whole-text encoding with a public tokenizer, one distinct word at a time.

Both tokenizers cut a text at white space before any merge, so the ids of a text are those of its words one after
the other. Each Python worker keeps a bounded cache from word to ids; the ``tokenizers`` library encodes what is
not in it. Texts with the separators U+001C to U+001F, which Python and the library class differently, are given
to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array

from quern.llm.common import worker_cache

SPACED = re.compile(r"\s*\S+|\s+")
ODD = re.compile("[\x1c-\x1f]")
LATIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = ".,;:!?#$%&*|()<>-"
CACHE_WORDS = 300_000


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def by_ranks(path: str):
    """From a byte-level tokenizer file a function from a unit's bytes to its ids; None where ids don't rise with the merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, back = model["vocab"], {c: b for b, c in byte_letters().items()}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    singles = [vocab[c] for c in back]
    if model.get("ignore_merges") or made != sorted(made) or len(set(made)) != len(made) or (made and max(singles) > made[0]):
        return None
    known = {*made, *singles}
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if i in known}
    return tiktoken.Encoding("units", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Cache(dict):
    """word -> its ids as little-endian unsigned 32-bit integers, by ``make``. Two generations bound its memory."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class Words:
    """Ids of texts from those of their words.

    A run of Latin-1 letters is one unit of either pattern, so its ids are those of the library's model on that unit, and
    punctuation after it is the next unit; the library's whole pipeline encodes all other words. A byte-level vocabulary whose
    ids rise with its merges gives each unit the same ids by ranks, which ``tiktoken`` finds without an object a token.
    """

    def __init__(self, path: str, spaced: bool, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.spaced, self.letters = self.tokenizer.model, spaced, byte_letters()
        self.ranks = by_ranks(path) if spaced else None
        # Words as they stand; for byte-level patterns also words after one space, kept without it.
        self.plain, self.after_space = Cache(self.new, limit // 4 if spaced else limit), Cache(self.new_after_space, limit)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def unit(self, letters: str) -> bytes:
        """Ids of letters in the case that the vocabulary takes, perhaps after a space."""
        if self.ranks:
            return array("I", self.ranks(letters.encode())).tobytes()
        return array("I", [t.id for t in self.model.tokenize(letters.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def new_after_space(self, word: str) -> bytes:
        if word.isalpha() and LATIN.fullmatch(word):
            return self.unit(" " + word)
        head = word.rstrip(MARKS)
        if len(head) < len(word) and LATIN.fullmatch(head):
            return self.after_space[head] + self.plain[word[len(head) :]]
        return self.new(" " + word)

    def new(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and not self.spaced:
            return array("I", [t.id for t in self.model.tokenize(word.lower())]).tobytes()
        if LATIN.fullmatch(word):
            return self.unit(word if self.spaced else word.lower())
        head = word.rstrip(MARKS)
        if len(head) < len(word) and LATIN.fullmatch(head):
            return self.plain[head] + self.plain[word[len(head) :]]
        return self.whole(word)

    def ids(self, text: str) -> bytes:
        if ODD.search(text):
            return self.whole(text)
        if self.spaced:
            return self.spaced_ids(text)
        if "<|" not in text:
            try:  # Latin-1 letters lower-case one by one, as the library does: fewer distinct words
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.plain.__getitem__, text.split()))

    def spaced_ids(self, text: str) -> bytes:
        """Words that only single spaces or line breaks part are looked up without them; a line break between two words is a unit of
        its own. Any other white space goes with the word after it."""
        if text and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"):
            lines = [line.split(" ") for line in text.split("\n")]
            if sum(map(len, lines)) == len(text.split()):
                after = self.after_space.__getitem__
                return self.plain["\n"].join([self.plain[line[0]] + b"".join(map(after, line[1:])) for line in lines])
        return b"".join(map(self.plain.__getitem__, SPACED.findall(text)))


def words(path: str) -> Words:
    """The cache of this worker for a tokenizer file."""

    def build() -> Words:
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)["pre_tokenizer"]["type"]
        return Words(path, spaced=kind == "ByteLevel")

    return worker_cache(f"words {path}", build)
