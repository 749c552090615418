"""Every operator on small fixtures: brute force, round trips, nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from quern.llm import langid, minhash, mixing, packing, quality, sharding, suffixdedup, tokencount, tokenfiles, topk  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, _pid int, size string"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with nulls, blanks, copies, near copies, shared passages, repeats, odd characters; extra columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [None, "", " \n\t ", "one", "Two words", "x" * 900, "é" * 500, "naïve Café — “quotes” 12345", "a  b\r\nc\x1cd", "<|endoftext|> don't"]
    base = [sentence(rng, 120, words) for _ in range(6)]
    texts += base + base[:3]
    for t in base[:4]:
        w = t.split()
        for k in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    passage = sentence(rng, 90, words)
    texts += [sentence(rng, 30, words) + " " + passage + " " + sentence(rng, 30, words) for _ in range(4)]
    texts += [passage + "\n" + passage, sentence(rng, 4000, words)]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    out += [(None, "no id", "en", "a", 5, "x", 1, "y"), (None, None, None, None, 0, "x", 1, "y"), out[3], out[12], out[12]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t, n):
    w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, rows, n):
    sets = [shingle_set(r[1], n) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    name = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i]:
            name[top(i)] = min(name.get(top(i), r[0]), r[0])
    want = Counter()
    for i, r in enumerate(rows):
        c = name.get(top(i)) if sets[i] else r[0]
        want[(r[0], len(sets[i]), c, r[0] == c)] += 1
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, shingle=n).collect())
    assert got == want


def test_near_duplicates_of_no_rows(none):
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_without_ids(spark):
    """Rows of null doc_id link near copies: with each other, with named rows, and as a bridge between two of them."""
    w = [f"w{i}" for i in range(100)]
    change = lambda t, *at: [f"new{i}" if i in at else x for i, x in enumerate(t)]
    far = change(w, *range(16))
    bridge = change(w, *range(8))
    u, v = [f"u{i}" for i in range(50)], [f"v{i}" for i in range(50)]
    rows = [(3, w), (None, bridge), (4, far), (None, change(bridge, 99)), (None, u), (None, change(u, 3)), (8, v), (None, change(v, 4)), (None, change(v, 4)), (9, ["alone", "here"])]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"), shingle=1).collect())
    assert got == Counter([(3, 100, 3, True), (4, 100, 3, False), *[(None, 100, 3, False)] * 2, *[(None, 50, None, True)] * 2, (8, 50, 8, True), *[(None, 50, 8, False)] * 2, (9, 2, 9, True)])


@pytest.mark.parametrize("block", [2, 7])
def test_near_duplicates_keep_every_pair(spark, monkeypatch, block):
    """Families of near copies of near copies, in small blocks and splits: no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SPLIT", 3)
    rng = random.Random(block)
    texts = []
    for _ in range(5):
        family = [[f"x{rng.random()}" for _ in range(40)]]
        for _ in range(30):
            t = list(rng.choice(family))
            for _ in range(rng.randint(1, 6)):
                t[rng.randrange(40)] = f"y{rng.random()}"
            family.append(t)
        texts += family
    sets = [set(t) for t in texts]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=1).collect()} == {i: top(i) for i in range(len(sets))}
    assert len({top(i) for i in range(len(sets))}) > 10


def test_near_duplicates_across_components(spark, monkeypatch):
    """A link that no star shows: a bucket whose members are linked in a chain, in blocks of two."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"v{rng.random()}" for _ in range(3)] + words[k + 3 :]) for k in range(0, 57, 3)] + [" ".join(words)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=1).collect()}
    assert set(got.values()) == {0}


def test_near_duplicates_at_bitmap_edge(spark):
    """The hash of doc_id 1314495 is 0 modulo the bitmap's size."""
    words = [f"w{i}" for i in range(60)]
    texts = [(1314495, " ".join(words)), (1314496, " ".join([*words[:-1], "changed"])), (7, "quite another text")]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=1).collect()}
    assert got == {1314495: (1314495, True), 1314496: (1314495, False), 7: (7, True)}


def test_signature_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    mult, add = minhash.functions()
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:889], rng.integers(0, 1 << 63, 111, dtype=np.uint64)))
    x, y = minhash.signature(a, mult, add), minhash.signature(b, mult, add)
    low = (np.uint64(3) & x) == (np.uint64(3) & y)
    assert abs((low.mean() - 0.25) / 0.75 - 0.8) < 0.12


def test_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(size=8) * rng.lognormal()]) for i in range(400)]
    vecs += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, [0.0] * 8), (405, vecs[0][1]), (None, [1.0] * 8), (450, [0.0] * 8), (500, [9.0, 9.0])]
    df = spark.createDataFrame([(*v, 1) for v in vecs], "vec_id long, embedding array<double>, score int")
    ok = {i: np.floor(256 * np.array(list(v) + [0.0] * (8 - len(v)))).astype(int) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ok if i % 50 == 0):
        s = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q)[:5]
        want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    from pyspark.sql import functions as F

    for bucket, ask in ((3, 4), (16, 2), (2048, 4096)):
        got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, bucket=bucket, queries=ask).collect()]
        assert set(got) == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert {tuple(r) for r in topk.top_k(df.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).collect()} == {(0, 1, 1, int(ok[0] @ ok[1]))}


def test_sharding(docs, rows, none):
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    load = Counter(r.shard for r in got)
    assert max(load.values()) - min(load[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(load[s]))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.shard(none).count() == 0


def test_ring_walk_and_movement():
    rng = random.Random(1)
    counts = [rng.choice((0, 0, 1, 3, 50)) for _ in range(512)]
    counts[7] = 4000  # a hot slot
    runs = sharding.spread(counts, sharding.ring(8, 16, 512), 8)
    assert Counter({s: n for s, n in enumerate(counts) if n}) == sum((Counter({a: e - f}) for a, f, e, _, _ in runs), Counter())
    load = Counter()
    for _, f, e, s, base in runs:
        assert base == load[s]
        load[s] += e - f
    assert max(load.values()) - min(load.values()) <= 1
    a, b = sharding.ring(8), sharding.ring(9)
    assert all(y in (x, 8) for x, y in zip(a, b)) and 0.05 < sum(y == 8 for y in b) / len(b) < 0.2


def test_sharding_against_the_walk(spark, docs, rows):
    """Every key walks alone in the brute force; equal rows may swap places."""
    from pyspark.sql import functions as F

    hot = rows + [rows[12]] * 40 + [(7, None, None, None, 0, "x", 1, "y")] * 30
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(hot)], "i long, " + SCHEMA).repartition(5)
    keys = [r.k for r in df.select("i", F.xxhash64(F.coalesce("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))).alias("k")).orderBy("i").collect()]
    for shards, vnodes, slots in ((8, 64, 4096), (3, 2, 8), (8, 1, 8)):
        want = Counter((r[0], zlib.crc32((r[1] or "").encode()), *x) for r, x in zip(hot, sharding.brute_force([r[:2] for r in hot], keys, shards, vnodes, slots)))
        assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard(df, shards, vnodes, slots).collect()) == want


def test_language_id(spark, none):
    rng = random.Random(8)
    say = {"en": "the of and to in is that it was for with his they have this".split(), "de": "der die und das ist nicht ein eine mit auf für wird werden über".split()}
    made = [(i, sentence(rng, rng.randint(4, 200), say[lang]), lang) for i in range(300) for lang in [["en", "de"][i % 2]]]
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 34 --", "de"), (None, sentence(rng, 30, say["de"]), "de"), (903, sentence(rng, 50_000, say["en"]), None)]
    df = spark.createDataFrame(made + extra, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, keep=("lang",)).collect()}
    assert all(got[i].lang_pred == lang and got[i].accepted and 0 <= got[i].score <= 1 for i, _, lang in made)
    assert all((got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False) for i in (900, 901, 902))
    assert got[None].lang_pred == "de" and got[903].lang_pred == "en"
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    tie = langid.predict(df.where("doc_id = 0"), {"x": b"abc", "w": b"abc"}).first()
    assert (tie.lang_pred, tie.accepted) == ("w", False)


def test_language_id_of_shared_headers_and_rare_languages(spark):
    """Texts are learnt from beyond a header that all share; 70 odd lang values are no error."""
    rng = random.Random(8)
    say = {"en": "the of and to in is that it was for with his they have this".split(), "de": "der die und das ist nicht ein eine mit auf für wird werden über".split()}
    header = sentence(rng, 150, ["lorem", "ipsum", "dolor", "amet"])
    made = [(i, header + " " + sentence(rng, 600, say[lang]), lang) for i in range(120) for lang in [["en", "de"][i % 2]]]
    body = [(1000 + i, sentence(rng, 40, say[lang]), lang) for i in range(20) for lang in [["en", "de"][i % 2]]]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    contents = langid.fit(df)
    assert b"the" in contents["en"].split() and "für".encode() in contents["de"].split()
    new = spark.createDataFrame(body, df.schema)
    assert all(r.lang_pred == r.lang and r.accepted for r in langid.predict(new, contents, keep=("lang",)).collect())
    rare = df.unionByName(spark.createDataFrame([(2000 + i, f"odd{i} text", f"x{i}") for i in range(70)], df.schema))
    assert len(langid.fit(rare)) == 72


def test_language_id_against_brute_force(docs, rows):
    """Every text encoded anew with a fresh compressor per block and language, and the dictionary's greedy order by plain search."""
    import zstandard as z

    contents = {"en": langid.normal(" ".join(r[1] or "" for r in rows[10:14])), "de": langid.normal(" ".join(r[1] or "" for r in rows[14:16])), "xx": b"zz"}
    want = Counter()
    for r in rows:
        if r[1] is None or not any(c.isalpha() for c in r[1]):
            want[(r[0], r[2], r[3], "und", 0.0, False)] += 1
            continue
        t, size = langid.normal(r[1]), {}
        for lang, d in contents.items():
            p = z.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=langid.MATCH, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[lang] = 0
            for i in range(0, len(t), langid.BLOCK):
                made = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p).compress(t[i : i + langid.BLOCK] + langid.FILLER)
                size[lang] += len(made)
        best = min(sorted(size), key=size.get)
        second = sorted(size.values())[1]
        want[(r[0], r[2], r[3], best, round(max(0.0, 1 - size[best] * 3 / sum(size.values())), 9), (second - size[best]) / second > langid.MARGIN)] += 1
    got = langid.predict(docs, contents, keep=("lang", "source")).collect()
    assert Counter((r.doc_id, r.lang, r.source, r.lang_pred, round(r.score, 9), r.accepted) for r in got) == want
    texts = [b"aa bb cc dd", b"aa bb ee", b"ff gg", b"aa bb ee"]
    assert langid.content(texts, 1000, 1) == b" ".join(sorted({w for t in texts for w in t.split()}, key=lambda w: (-{b"aa": 1, b"bb": 1}.get(w, 1), w))[::-1])
    assert len(langid.content(texts * 50, 12, 4)) <= 12 and langid.content([], 10) == b""


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r[0], len(split(r[1])), r[3]) for r in rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(split(r[1]))
    left, goal, total = {"a": 5, "b": 2, "c": 1, None: 5}, {}, float(sum(size.values()))
    while True:
        w = sum(left.values())
        full = [s for s in left if total * left[s] / w >= 3 * size[s]]
        if not full:
            goal |= {s: total * left[s] / w for s in left}
            break
        for s in full:
            goal[s] = 3.0 * size[s]
            total -= goal[s]
            del left[s]
        if not left:
            break
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - goal[s]) <= 3 * max(len(split(r[1])) for r in rows if r[3] == s)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(none).count() == 0


def test_best_two_fit():
    rng = random.Random(4)
    for _ in range(200):
        counts = Counter(rng.choice((rng.randint(1, 30), rng.randint(1, 100))) for _ in range(rng.randint(0, 80)))
        out = packing.best_two_fit(counts, 100)
        used = Counter()
        for pattern, bins in out:
            assert bins > 0 and sum(k * n for k, n in pattern.items()) <= 100
            for k, n in pattern.items():
                used[k] += n * bins
        assert used == counts
    # 60 + 30 leaves 10; replacing 30 by 25 + 15 fills the bin.
    assert packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == ({60: 1, 25: 1, 15: 1}, 1)


def test_best_two_fit_piece_by_piece():
    """The histogram's bins against the rule applied to single pieces, searching all pairs."""

    def plain(lengths, cap):
        left, bins = sorted(lengths, reverse=True), []
        while left:
            own, gap = [], cap
            for n in list(left):  # greedily: the longest that fits
                if n <= gap:
                    own.append(n), left.remove(n)
                    gap -= n
            small = min(own)
            best = max(((left[i] + left[j]) for i in range(len(left)) for j in range(i) if small < left[i] + left[j] <= gap + small), default=0) if gap else 0
            if best:  # of pairs that fit equally, that of the shortest piece
                pair = min(sorted((left[i], left[j])) for i in range(len(left)) for j in range(i) if left[i] + left[j] == best)
                own.remove(small)
                for n in pair:
                    own.append(n), left.remove(n)
                left.append(small)
                left.sort(reverse=True)
            bins.append(tuple(sorted(own)))
        return bins

    rng = random.Random(14)
    for _ in range(300):
        lengths = [rng.randint(1, rng.choice((12, 60, 100))) for _ in range(rng.randint(0, 40))]
        # The histogram's way repeats a pattern while the pieces last; piece by piece the same bins come again and again.
        made = [tuple(sorted(Counter(p).elements())) for p, n in packing.best_two_fit(Counter(lengths), 100) for _ in range(n)]
        want = plain(lengths, 100)
        assert len(made) <= len(want) + 1 and sum(map(sum, made)) == sum(lengths)
        if len(set(lengths)) == len(lengths):
            assert made == want


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(r[0], k, a, struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    gaps: list[int] = []  # no more bins than first fit on falling lengths
    for n in sorted((len(x[3]) // 4 for x in want.elements()), reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(1024 - n)
        else:
            gaps[k] -= n
    assert len(bins) <= len(gaps)
    assert packing.pack(none, path).count() == 0


def test_token_counts(docs, rows, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    t = Tokenizer(models.Unigram(tokencount.vocabulary(path), 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    want = Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in tokencount.count_tokens(docs, path).collect()) == want
    assert tokencount.count_tokens(none, path).count() == 0


def test_token_count_ties():
    """Equal scores: the library's choice decides how many pieces there are."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(6)
    for _ in range(60):
        pieces = {"<unk>": 0.0, "▁": -3.0} | {"".join(rng.choice("ab▁"[: rng.choice((2, 3))]) for _ in range(rng.randint(1, 4))): float(-rng.randint(1, 4)) for _ in range(10)}
        vocab = list(pieces.items())
        t = Tokenizer(models.Unigram(vocab, 0, False))
        t.pre_tokenizer = pre_tokenizers.Metaspace()
        c = tokencount.Counter(vocab)
        for _ in range(20):
            s = "".join(rng.choice("ab ") for _ in range(12))
            if "b" in pieces and "a" in pieces:
                assert c.text(s)[0] == len(t.encode(s, add_special_tokens=False).ids), (vocab, s)


def test_suffix_array():
    rng = random.Random(7)
    for _ in range(1500):
        s = [rng.randint(0, rng.choice((0, 1, 2, 5))) for _ in range(rng.randint(0, 40))]
        from quern.llm.suffixarray import suffix_array

        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(docs, rows, none, monkeypatch, hot):
    """``hot`` 1 sends every bucket to the counting way for very large ones: the result is the same."""
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    want = Counter((r[0], *x) for r, x in zip(rows, suffixdedup.brute_force([r[1] for r in rows])))
    got = suffixdedup.dedup(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.rest).hexdigest()) for r in got) == want
    assert sum(x[2] for x in want) > 5000
    assert suffixdedup.dedup(none).count() == 0


def test_suffix_dedup_boundaries(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    p, q = noise(400), noise(399)
    texts = [noise(300) + p + noise(100), noise(20) + p, q + "x", q + "y", noise(50) + "ab" * 400, p[:200] + noise(10) + p[200:], "z" * 401, noise(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.rest).hexdigest()) for r in suffixdedup.dedup(df).collect()}
    assert got == dict(enumerate(suffixdedup.brute_force(texts)))


def base_counts(t):
    t = t or ""
    w, seen, dup = split(t), set(), 0
    for line in t.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    at, cover = {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            cover.update(x for i in v for x in range(i, i + 8))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality(spark, docs, rows, none):
    rng = random.Random(3)
    good = [(i, "\n".join("The " + sentence(rng, 9, ["cat", "dog", "walks", "home", "slowly", "again"]) + "." for _ in range(8)), 1) for i in range(60)]
    bad = [(100 + i, "\n".join("### $$$ " + sentence(rng, 3, ["buy", "now", "win", "cash"]) + " %%% ***" for _ in range(8)), 0) for i in range(60)]
    made = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    field = quality.train(made.select("doc_id", "text"), made.where("doc_id % 2 = 0").select("doc_id", "quality"))
    held = quality.assess(made.where("doc_id % 2 = 1"), field, keep=("quality",)).where("NOT base_failed").collect()
    assert held and all(r.kept == (r.quality == 1) for r in held)
    got = quality.assess(docs, field).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r[0], *base_counts(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.assess(none, field).count() == 0
    assert quality.train(none, spark.createDataFrame([], "doc_id long, quality int")).viterbi([[1.0] * len(quality.FEATURES)] and __import__("numpy").ones((2, len(quality.FEATURES)))) == [1, 1]


def test_gradient_against_all_paths():
    """Likelihood by listing all paths, gradient by differences."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    f = len(quality.FEATURES)
    seqs = [(rng.normal(size=(n, f)), rng.integers(0, 2, n)) for n in (3, 1, 5, 2)]
    emit, move = rng.normal(size=(f, 2)) / 4, rng.normal(size=(2, 2)) / 4

    def likelihood(emit, move):
        total = 0.0
        for x, y in seqs:
            e = x @ emit
            score = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p[:-1], p[1:]))
            total += score(y) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=len(y))))
        return total / sum(len(y) for _, y in seqs)

    value, ge, gm = quality.gradient(quality.Batch(seqs), emit, move)
    assert abs(value - likelihood(emit, move)) < 1e-9
    h = 1e-5
    for w, g in ((emit, ge), (move, gm)):
        for i in np.ndindex(w.shape):
            up = [a.copy() for a in (emit, move)]
            down = [a.copy() for a in (emit, move)]
            k = 0 if w is emit else 1
            up[k][i] += h
            down[k][i] -= h
            assert abs((likelihood(*up) - likelihood(*down)) / 2 / h - g[i]) < 1e-6


def test_quality_of_mixed_documents(spark):
    """Clean lines and boilerplate in one document are told apart line by line, though only documents are labelled."""
    rng = random.Random(4)
    clean = lambda: "The " + sentence(rng, 9, ["cat", "dog", "walks", "home", "slowly", "again"]) + "."
    junk = lambda: "### $$$ " + sentence(rng, 6, ["buy", "now", "win", "cash"]) + " %%% ***"
    rows = [(i, "\n".join(clean() for _ in range(8)), 1) for i in range(60)] + [(100 + i, "\n".join([clean(), clean(), *(junk() for _ in range(6))]), 0) for i in range(60)]
    train = spark.createDataFrame([*rows, (5, "\n".join(junk() for _ in range(9)), 1)], "doc_id long, text string, quality int")
    field = quality.train(train.select("doc_id", "text"), train.select("doc_id", "quality"))
    assert field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0]
    mixed = [(i, "\n".join([*(clean() for _ in range(a)), *(junk() for _ in range(b)), *(clean() for _ in range(c))])) for i, (a, b, c) in enumerate([(6, 2, 0), (2, 6, 0), (3, 3, 3), (1, 7, 1), (0, 4, 2)])]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(mixed, "doc_id long, text string"), field).collect()}
    for i, t in mixed:
        good = sum(len(split(x)) for x in t.split("\n") if x.startswith("The"))
        assert got[i].n_content_words == good and got[i].kept == (2 * good >= got[i].n_words)


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    f = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    for n in range(1, 7):
        x = rng.normal(size=(n, len(quality.FEATURES)))
        e = x @ f.emit
        best = max(itertools.product((0, 1), repeat=n), key=lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(f.move[a, b] for a, b in zip(p[:-1], p[1:])))
        assert f.viterbi(x) == list(best)


def test_token_files(docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    at, want = 0, []
    spark = docs.sparkSession
    texts = [r[1] for r in rows]
    hashed = spark.createDataFrame(list(enumerate(texts)), "i long, t string").selectExpr("i", "xxhash64(t) AS h").collect()
    key = {texts[r.i]: r.h for r in hashed}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]])):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], at, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    got = tokenfiles.round_trip(docs, path).collect()
    assert Counter((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got) == Counter(want)
    assert tokenfiles.round_trip(none, path).count() == 0
    hot = spark.createDataFrame([(None if i % 3 else 5, f"text {i % 7}") for i in range(300)], "doc_id long, text string").repartition(4)
    back = tokenfiles.round_trip(hot, path).collect()
    order = sorted(back, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None] * 200 + [5] * 100
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:i]) for i in range(300)]
    assert Counter((r.doc_id, bytes(r.ids)) for r in back) == Counter((None if i % 3 else 5, struct.pack("<3I", *t.encode(f"text {i % 7}", add_special_tokens=False).ids, 2)) for i in range(300))


def test_rans_parts_and_damage(monkeypatch):
    import numpy as np

    from quern.llm import rans

    rng = np.random.default_rng(4)
    for n in (1, 5, 511, 512, 5000, 40_000):
        ids = np.minimum(rng.geometric(0.01, n), 40_000).astype(np.uint32)
        symbols, freq = rans.table(ids)
        ranks = np.searchsorted(symbols, ids)
        words, states, places = rans.encode(ranks, freq, 64, 16)
        slot = rans.slots(freq)
        assert (symbols[rans.decode(words, states, places, freq, slot, n, 64, 16)] == ids).all()
        parts = [rans.decode(words, states, places, freq, slot, n, 64, 16, part=k) for k in range(len(places))]
        assert (symbols[np.concatenate(parts)] == ids).all()
    monkeypatch.setattr(tokenfiles, "BLOCK_TOKENS", 100)
    made = [(i, np.arange(i + 1, dtype="<u4").tobytes()) for i in range(40)] + [(None, b"\x02\0\0\0")]
    data, blocks = tokenfiles.segment_bytes(made)
    table = tokenfiles.read_table(data)
    table = (*table, rans.slots(table[1]))
    back = []
    for at, size, _, _ in blocks:
        own, lengths, ids = tokenfiles.read_block(data[at : at + size], *table)
        for d, k in zip(own, lengths):
            back.append((d, ids[: 4 * k]))
            ids = ids[4 * k :]
    assert back == made and len(blocks) > 3
    at, size = blocks[1][:2]
    hurt = bytearray(data[at : at + size])
    hurt[len(hurt) // 2] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.read_block(bytes(hurt), *table)


def test_very_long_texts(spark):
    """A text of 400 KB beside a near copy of it and short ones, through the operators that have a brute force."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = sentence(rng, 62_000, words)
    near = long[:200_000] + " changed here " + long[200_000:]
    texts = [long, near, "short one", None, sentence(rng, 50, words)]
    assert len(long) > 350_000
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=2).collect()}
    assert got == {i: (len(shingle_set(t, 2)), 0 if i < 2 else i) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in mixing.mix(df).collect()} == {i: len(split(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in sharding.shard(df).collect()} == {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.rest).hexdigest()) for r in suffixdedup.dedup(df).collect()} == dict(enumerate(suffixdedup.brute_force(texts)))
    field = quality.fit([])
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.assess(df, field).collect()} == {i: base_counts(t) for i, t in enumerate(texts)}
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    pieces: dict = {}
    for r in sorted(packing.pack(df, path).collect(), key=lambda r: (r.doc_id, r.piece)):
        pieces[r.doc_id] = pieces.get(r.doc_id, b"") + bytes(r.ids)
    assert pieces == {i: struct.pack(f"<{len(v)}I", *v) for i, v in want.items()}
    back = {r.doc_id: bytes(r.ids) for r in tokenfiles.round_trip(df, path).collect()}
    assert back == pieces
