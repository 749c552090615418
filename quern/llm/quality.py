"""Quality rules with line labels from a linear-chain conditional random field.

Each line with a word is content or boilerplate. Line features feed a two-state chain whose weights are fitted here by
conditional likelihood on a bounded sample of labelled documents, taken whole. Only documents are labelled, so lines get weak
labels first: without its transitions the same model tells which lines of good documents stand out in bad ones, and a
document's lines follow that while the document's own label keeps the greater part of its words. The chain learns
from these sequences, which change state inside documents. Viterbi decoding marks the lines of every text, and the share of
its words on content lines decides retention. Documents that fail the base rules are dropped before that.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the fit: labelled documents.
SAMPLE_DOCS = 1000
SHARE, MIN_WORDS, WINDOW, REPEAT_PERCENT = 0.5, 20, 8, 30
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "symbols_per_word", "symbols_many", "upper_share", "shouted", "exclaimed", "digits", "repeated_line", "repeated_words", "short", "ends_well", "starts_well", "long_words", "first", "last")


def analyse(data, offs):
    """Base counts per text and, per line with a word, its text, word count and features, for texts at ``offs``."""
    import numpy as np

    from quern.llm import hashing as H

    U, n, texts = np.uint64, len(data), len(offs) - 1
    start, end, h, first = H.words(data, offs)
    n_words = np.diff(first)
    c = H.prefix(data)

    def per(mask, a, b):
        s = np.concatenate(([0], np.cumsum(mask)))
        return s[b] - s[a]

    is_word = ~H.SPACE[data]
    head = (data & 0xC0) != 0x80
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    out = {"n_words": n_words, "word_chars": per(is_word & head, offs[:-1], offs[1:]), "n_symbols": per(symbol, offs[:-1], offs[1:])}

    # Words inside windows of WINDOW words that occur twice in their text.
    doc_of = np.repeat(np.arange(texts), n_words)
    covered = np.zeros(len(h) + 1, np.int64)
    k = len(h) - WINDOW + 1
    if k > 0:
        acc = h[:k].copy()
        for i in range(1, WINDOW):
            acc = H.mix(acc * H.P + h[i : k + i])
        at = np.flatnonzero(doc_of[:k] == doc_of[WINDOW - 1 :])
        key = H.mix(acc[at] + doc_of[at].astype(U) * H.P)
        _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[count[inv] > 1]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = per(repeat, first[:-1], first[1:])

    # Lines: cut at \n and at the texts' ends.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((offs[:-1], breaks + 1)))
    begin = begin[begin < n]
    stop = np.searchsorted(breaks, begin)
    stop = np.where(stop < len(breaks), breaks[np.minimum(stop, len(breaks) - 1)] if len(breaks) else n, n)
    text = np.searchsorted(offs, begin, side="right") - 1
    stop = np.minimum(stop, offs[text + 1])
    w0, w1 = np.searchsorted(start, begin), np.searchsorted(start, stop)
    full = w1 > w0
    begin, stop, text, w0, w1 = begin[full], stop[full], text[full], w0[full], w1[full]
    words = w1 - w0
    key = H.mix(H.spans(c, begin, stop) + (stop - begin).astype(U) * H.P) + text.astype(U) * H.P_INV
    _, at, inv, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    dup = np.ones(len(begin), bool)
    dup[at] = False
    out["n_dup_lines"] = np.bincount(text[dup], minlength=texts)

    letters = per((data >= 65) & (data <= 90) | (data >= 97) & (data <= 122), begin, stop)
    upper = per((data >= 65) & (data <= 90), begin, stop)
    sym = per(symbol, begin, stop) / words
    chars = per(is_word & head, begin, stop)
    up = upper / np.maximum(letters, 1)
    x = np.zeros((len(begin), len(FEATURES)), np.float64)
    last = data[end[w1 - 1] - 1] if len(begin) else np.zeros(0, np.uint8)
    lead = data[start[w0]] if len(begin) else np.zeros(0, np.uint8)
    new = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
    x[:, 0] = 1
    x[:, 1] = np.minimum(sym, 3)
    x[:, 2] = sym > 0.4
    x[:, 3] = up
    x[:, 4] = (up > 0.6) & (letters > 3)
    x[:, 5] = np.minimum(per(data == 33, begin, stop) / words, 2)
    x[:, 6] = per((data >= 48) & (data <= 57), begin, stop) / np.maximum(chars, 1)
    x[:, 7] = count[inv] > 1
    x[:, 8] = per(repeat, w0, w1) / words
    x[:, 9] = words < 4
    x[:, 10] = np.isin(last, np.frombuffer(b".?!\"')", np.uint8))
    x[:, 11] = (lead >= 65) & (lead <= 90) | (lead >= 0xC3)
    x[:, 12] = np.minimum(chars / words, 20) / 20
    x[:, 13] = new
    x[:, 14] = np.concatenate((new[1:], [True])) if len(text) else new
    return out, text, words, x


class Field:
    """Emission weights (features x 2) and transitions (2 x 2); state 1 is content."""

    def __init__(self, emit, move):
        self.emit, self.move = emit, move

    def viterbi(self, x) -> list[int]:
        """The best states of one text's lines; ties go to content."""
        if not len(x):
            return []
        (aa, ab), (ba, bb) = self.move.tolist()
        back, s0, s1 = [], None, None
        for e0, e1 in (x @ self.emit).tolist():
            if s0 is None:
                s0, s1 = e0, e1
                continue
            p0, p1 = s1 + ba >= s0 + aa, s1 + bb >= s0 + ab
            s0, s1 = (s1 + ba if p0 else s0 + aa) + e0, (s1 + bb if p1 else s0 + ab) + e1
            back.append((p0, p1))
        path = [int(s1 >= s0)]
        for p in reversed(back):
            path.append(int(p[path[-1]]))
        return path[::-1]


class Batch:
    """Sequences of (x, y) laid out by step: row t holds the t-th line of every sequence that has one, longest first."""

    def __init__(self, sequences: list):
        import numpy as np

        seqs = sorted(sequences, key=lambda s: -len(s[1]))
        size = np.array([len(y) for _, y in seqs])
        self.width = [int(np.count_nonzero(size > t)) for t in range(int(size[0]))]
        self.begin = np.concatenate(([0], np.cumsum(self.width)))
        step = np.concatenate([np.arange(n) for n in size])
        at = self.begin[step] + np.repeat(np.arange(len(seqs)), size)
        self.x = np.zeros((len(step), len(FEATURES)))
        self.y = np.zeros(len(step), int)
        self.x[at], self.y[at] = np.concatenate([x for x, _ in seqs]), np.concatenate([y for _, y in seqs])


def gradient(batch: Batch, emit, move):
    """Mean conditional log-likelihood of ``batch`` a line, and its gradients by emit and move."""
    import numpy as np

    e, w, b, total = batch.x @ emit, batch.width, batch.begin, len(batch.y)
    fwd, bwd = e.copy(), np.zeros_like(e)
    for t in range(1, len(w)):
        v, q = fwd[b[t - 1] : b[t - 1] + w[t]], b[t]
        fwd[q : q + w[t]] += np.logaddexp(v[:, :1] + move[0], v[:, 1:] + move[1])
    for t in range(len(w) - 2, -1, -1):
        q = b[t + 1]
        v = e[q : q + w[t + 1]] + bwd[q : q + w[t + 1]]
        bwd[b[t] : b[t] + w[t + 1]] = np.logaddexp(v[:, :1] + move[:, 0], v[:, 1:] + move[:, 1])
    z = np.logaddexp(fwd[:, 0] + bwd[:, 0], fwd[:, 1] + bwd[:, 1])  # of its sequence, at every line
    prob = np.exp(fwd + bwd - z[:, None])
    nxt = np.concatenate([np.arange(b[t], b[t] + w[t]) for t in range(1, len(w))] or [np.zeros(0, int)])
    own = np.concatenate([np.arange(b[t - 1], b[t - 1] + w[t]) for t in range(1, len(w))] or [np.zeros(0, int)])
    pair = np.exp(fwd[own, :, None] + move + (e[nxt] + bwd[nxt])[:, None, :] - z[own, None, None])
    hot = np.eye(2)[batch.y]
    gold = hot[own].T @ hot[nxt]
    value = (e * hot).sum() + (gold * move).sum() - z[: w[0]].sum()
    return value / total, batch.x.T @ (hot - prob) / total, (gold - pair.sum(axis=0)) / total


def fit(sequences: list, steps: int = 120, rate: float = 0.15, ridge: float = 1e-3, chain: bool = True) -> Field:
    """Weights by gradient ascent (Adam) on the conditional log-likelihood of ``sequences`` of (x, y); without ``chain`` each line
    stands alone. No sequences: all is content. The steps of a gradient follow the longest sequence."""
    import numpy as np

    f = len(FEATURES)
    theta = np.zeros(2 * f + 4)
    if not sequences:
        theta[1] = 1.0  # without labels, all is content
        return Field(theta[: 2 * f].reshape(f, 2), theta[2 * f :].reshape(2, 2))
    if not chain:
        sequences = [(x[i : i + 1], y[i : i + 1]) for x, y in sequences for i in range(len(y))]
    batch = Batch(sequences)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, ge, gm = gradient(batch, theta[: 2 * f].reshape(f, 2), theta[2 * f :].reshape(2, 2))
        g = np.concatenate((ge.ravel(), gm.ravel())) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[: 2 * f].reshape(f, 2), theta[2 * f :].reshape(2, 2))


def weak_labels(documents: list, share: float = SHARE) -> list:
    """Sequences (x, y) for ``documents`` of (words per line, x, label): lines that the line model holds for the other state take it,
    the surest first, while the document's label keeps more than ``share`` of its words (of a bad one's, at least as much)."""
    import numpy as np

    line = fit([(x, np.full(len(w), q)) for w, x, q in documents], chain=False)
    out = []
    for w, x, q in documents:
        e = x @ line.emit
        other = e[:, 1 - q] - e[:, q]
        order = np.argsort(-other, kind="stable")
        flip = order[(other[order] > 0) & (np.cumsum(w[order]) < (1 - share) * w.sum())]
        y = np.full(len(w), q)
        y[flip] = 1 - q
        out.append((x, y))
    return out


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Field:
    """A field from the ``limit`` labelled documents of lowest hash; labels has doc_id and quality (1 good, 0 bad).

    Of several labels of one doc_id the lower counts, of several texts the last by code point. The texts are taken whole and the
    fit runs in one task of ``limit`` documents; the driver gets the weights alone. No labels: all lines are content.
    """
    some = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # a parameter: safe to broadcast
    rows = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("quality").alias("quality"))

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        from quern.llm import hashing as H

        found = []
        for _, t, q in sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "quality")))):
            data, offs = H.text_bytes(pa.array([t]))
            _, _, words, x = analyse(data, offs)
            if len(words):
                found.append((words, x, int(q)))
        f = fit(weak_labels(found) if found else [])
        return pa.table({"w": pa.array([np.concatenate((f.emit.ravel(), f.move.ravel())).tolist()], pa.list_(pa.float64()))})

    made = rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, "w array<double>").collect()
    if not made:
        return fit([])
    import numpy as np

    w, f = np.array(made[0].w), len(FEATURES)
    return Field(w[: 2 * f].reshape(f, 2), w[2 * f :].reshape(2, 2))


def assess(docs: DataFrame, field: Field, share: float = SHARE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, those of ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_content_words,
    content_share, base_failed, kept; one row per row of ``docs``, in one pass and without a shuffle.

    Null and blank texts have no words: all counts 0, content_share 0, base_failed true. Texts of any length are taken
    whole. doc_id is passed on as it is. Empty input gives no rows.
    """
    emit, move, names = field.emit, field.move, ["doc_id", *keep]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from quern.llm import hashing as H

        crf = Field(emit, move)
        for b in batches:
            data, offs = H.text_bytes(b.column(len(names)))
            for i, j in H.slices(offs):
                base, text, words, x = analyse(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                cut = np.searchsorted(text, np.arange(j - i + 1))
                state = np.array([s for p, q in zip(cut[:-1], cut[1:]) for s in crf.viterbi(x[p:q])], np.int64)
                content = np.bincount(text, weights=words * state, minlength=j - i).astype(np.int64)
                n = base["n_words"]
                part = content / np.maximum(n, 1)
                failed = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * n)
                cols = [*[b.column(k).slice(i, j - i) for k in range(len(names))], *[pa.array(base[c].astype(np.int64)) for c in counts], pa.array(content), pa.array(part), pa.array(failed), pa.array(~failed & (part >= share))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *counts, "n_content_words", "content_share", "base_failed", "kept"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, {', '.join(f'{c} long' for c in counts)}, n_content_words long, content_share double, base_failed boolean, kept boolean")
