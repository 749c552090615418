"""The corpus pipeline's stages against their operators' rules on a small corpus with planted cases."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    say = {"en": "the of and to in is that it was for with his they have this from were when which".split(), "de": "der die und das ist nicht ein eine mit auf für wird werden über sich auch nach bei".split()}
    make = lambda lang, n: " ".join(rng.choice(say[lang]) + str(rng.choice(("", "s", "en", "ing", "t"))) for _ in range(n))
    rows = [(i, make(lang, rng.randint(40, 300)), lang, f"s{i % 3}") for i in range(60) for lang in [["en", "de"][i % 2]]]
    near = rows[0][1].split()
    near[5] = "other"
    passage = make("en", 120)
    rows += [(100, rows[3][1], "de", "s0"), (101, " ".join(near), "en", "s1"), (102, make("en", 80) + " " + passage + " " + make("en", 80), "en", "s2"), (103, make("en", 70) + " " + passage, "en", "s0"), (104, None, "en", "s0"), (105, "123 456", "en", "s0"), (100, rows[3][1], "de", "s0")]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    return d, rows, passage


def test_stages(spark, corpus):
    d, rows, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [f.__name__ for _, f in P.STAGES] == ["language", "near_duplicates", "repeats", "mixture", "sequences"]
    a = P.language(spark, docs, d).cache()
    assert a.columns == list(P.COLUMNS) and {r.doc_id for r in a.collect()} == {r[0] for r in rows} - {104, 105}
    b = P.near_duplicates(spark, a, d).cache()
    assert sorted(r.doc_id for r in b.collect()) == sorted({r[0] for r in rows} - {100, 101, 104, 105})
    c = P.repeats(spark, b, d).cache()
    text = {r.doc_id: r.text for r in c.collect()}
    assert passage not in text[102] and passage not in text[103] and all(text[r[0]] == r[1] for r in rows[:60])
    m = P.mixture(spark, c, d).cache()
    assert m.columns == list(P.COLUMNS) and {r.doc_id for r in m.collect()} <= set(text)
    out = P.sequences(spark, m, d)
    sizes = {r["sequence_id"]: r["n"] for r in out.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert sizes and max(sizes.values()) <= 1024


def plain_run(rows):
    """(doc_id, piece, start, ids) of the pipeline's result by plain loops over all texts."""
    import hashlib
    import math
    import re
    import struct

    import public_tokenizers
    from quern.llm import suffixdedup
    from tokenizers import Tokenizer

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    kept = sorted({r for r in rows if any(c.isalpha() for c in r[1] or "")})  # no text of this corpus lies between its languages
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(r[1].lower()) for r in kept)]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i, r in enumerate(kept):
        first[group[i]] = min(first.get(group[i], r), r)
    docs = sorted(first.values())
    cut = []
    for r, spans in zip(docs, suffixdedup.brute_force_words([r[1] for r in docs])):
        b, ends = r[1].encode(), [0, *[x for s in spans for x in s]]
        ends.append(len(b))
        rest = b"".join(b[s:e] for s, e in zip(ends[::2], ends[1::2])).decode("utf-8", "ignore")
        if not spans or words(rest):
            cut.append((r[0], rest, r[3], len(words(rest))))
    size, goal, left = Counter(), {}, {}
    for d in cut:
        size[d[2]] += d[3]
    left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    rest = float(sum(size.values()))
    while left:
        full = [s for s in left if rest * left[s] / sum(left.values()) >= 3 * size[s]]
        for s in full or list(left):
            goal[s] = 3.0 * size[s] if full else rest * left[s] / sum(left.values())
        if not full:
            break
        rest -= sum(goal[s] for s in full)
        left = {s: w for s, w in left.items() if s not in full}
    t, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for source in size:
        u, e = int(hashlib.md5(f"mix:{source}".encode()).hexdigest()[:7], 16) / (1 << 28), goal[source] / size[source]
        for k, d in enumerate(sorted((d for d in cut if d[2] == source), key=lambda d: (d[3], d[0])), 1):
            ids = t.encode(d[1], add_special_tokens=False).ids + [2]
            ends = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
            for piece, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                out[d[0], piece, a, struct.pack(f"<{b - a}I", *ids[a:b])] += math.floor(k * e + u) - math.floor((k - 1) * e + u)
    return +out


def test_run_against_plain_loops(spark, corpus):
    d, rows, _ = corpus
    got = P.run(spark, d).collect()
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == plain_run(rows)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024


def test_repeats_of_51_words(spark):
    """Passages are counted in words: 51 short ones go, whatever space is between them, 50 long ones stay."""
    rng = random.Random(12)
    make = lambda n, k: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(k)) for _ in range(n))
    short, tiny, long, whole = make(51, 4), make(51, 3), make(50, 12), make(60, 5)
    texts = [make(70, 6) + " " + short + " " + make(9, 6), short + "\n" + make(30, 6), make(40, 6) + " " + tiny + " é", tiny.replace(" ", "\n ") + " " + make(40, 6), make(30, 6) + " " + long, long + " " + make(30, 6), whole + "\n", whole, make(80, 6)]
    df = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.repeats(spark, df, "").collect()}
    assert short not in got[0] and short not in got[1] and tiny not in got[2] and got[3].split() == texts[3].split()[51:]
    assert [got[i] for i in (4, 5, 8)] == [texts[i] for i in (4, 5, 8)] and 6 not in got and 7 not in got


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    from quern.llm import suffixdedup

    monkeypatch.setattr(suffixdedup, "HOT", hot)
    rng = random.Random(13)
    make = lambda n: [rng.choice("abcdefghij") + rng.choice(("", "é", "st")) for _ in range(n)]
    pool = [make(n) for n in (30, 49, 50, 51, 52, 60, 120, 300)]
    texts = [rng.choice((" ", "\n", "  ")).join(make(rng.randint(0, 60)) + rng.choice(pool)[rng.randint(0, 9) :] + make(rng.randint(0, 60)) + rng.choice(pool)) for _ in range(40)]
    texts += [None, "", " ".join(["a"] * 130), texts[0], texts[1] + "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixdedup.dedup(df, window=suffixdedup.WORDS).collect()}
    assert got == dict(enumerate(suffixdedup.brute_force_words(texts))) and sum(map(len, got.values())) > 30


def test_near_duplicates_by_row(spark):
    """One row of each group stays, whatever its doc_id: null ones, one doc_id of two texts, copies without any doc_id."""
    rng = random.Random(14)
    make = lambda: [f"w{rng.randint(0, 10_000)}" for _ in range(80)]
    near = lambda w: " ".join(w[:40] + ["changed"] + w[41:])
    a, b, c, d, e, f, g = (make() for _ in range(7))
    say = " ".join
    rows = [(1, say(a)), (None, say(a)), (None, say(b)), (2, say(c)), (3, near(c)), (3, say(d)), (None, say(e)), (None, say(e)), (None, near(e)), (4, say(f)), (4, say(f)), (4, say(g)), (5, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_duplicates(spark, df, "")
    assert out.columns == list(P.COLUMNS)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    first = next(x for x in ((None, say(e)), (None, near(e))) if x in got)
    assert got == Counter([(1, say(a)), (None, say(b)), (2, say(c)), (3, say(d)), first, (4, say(f)), (4, say(g)), (5, None), (None, None)])


def test_stages_of_no_rows(spark, corpus, tmp_path):
    """Every stage of an empty table gives no rows and the columns of documents; the last its pieces' columns."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage_of in P.STAGES[:4]:
        out = stage_of(spark, docs, str(tmp_path))
        assert out.columns == list(P.COLUMNS) and out.count() == 0, name
    assert P.run(spark, str(tmp_path)).count() == 0
