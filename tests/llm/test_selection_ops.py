"""Exact groups, source divergence and importance resampling against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import divergence, exact, importance

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [
    (5, None, None, None), (6, "", "en", "b"), (7, "", None, "a"), (1, "tie one", "en", "a"), (1, "tie one", "en", "a"), (1, "tie two", "en", "b"), (None, "tie one", "en", "a"), (None, None, "", ""),
    (None, "no id", "fr", "a"), (None, "no id", "fr", "a"), (9, "word " * 60_000, "en", "c"), (10, "word " * 60_000, "en", "c"), (11, "x" * 300_000, "en", "c"), (12, "x" * 300_000 + "y", "en", "c"),
    (13, "é ß — 漢字 😀 <|endoftext|> a\0b İSTANBUL", "fr", "a"), (14, "TIE ONE", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("keep_id", F.lit("mine")).withColumn("kept", F.lit(7)).withColumn("n_words", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("at", F.lit(b"z"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return (text or "").encode().lower().decode()


# ---- op11


def check_exact(got, docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(doc_id)
    assert len(got) == len(docs)
    by_text = defaultdict(list)
    for r in got:
        by_text[r["sha"]].append(r)
    assert by_text.keys() == groups.keys()
    for sha, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        rows = by_text[sha]
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in rows)
        assert all(r["keep_id"] == best and r["group_size"] == len(ids) for r in rows)
        assert [r["doc_id"] for r in rows if r["kept"]] == [best]


def exact_rows(df, **how):
    return exact.exact_groups(df.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), **how).collect()


def test_op11_odd_input(odd, none):
    check_exact(exact_rows(odd), [r[:2] for r in ODD])
    found = exact.exact_groups(odd)
    assert found.columns == ["doc_id", "lang", "source", "n_words", "rank", "at", "keep_id", "group_size", "kept"]
    assert exact.exact_groups(none).collect() == []


@pytest.mark.parametrize("hot", [0, 4000])
def test_op11_tells_equal_beginnings_and_lengths_apart(spark, hot):
    rng = random.Random(3)
    docs = [(i, "same beginning " * 40 + rng.choice("abc") * rng.randrange(1, 4)) for i in range(600)]  # beginnings agree, most lengths too
    docs += [(1000 + i, rng.choice("pq") + "tail " * rng.randrange(1, 40)) for i in range(600)] + [(5000 + i, "hot") for i in range(hot)] + [(None, "hot")] * 3
    rng.shuffle(docs)
    check_exact(exact_rows(spark.createDataFrame(docs, "doc_id long, text string")), docs)


def test_op11_a_full_map_changes_nothing(spark, monkeypatch):
    """All keys on 64 bits: every row counts as repeated, the groups stay right."""
    monkeypatch.setattr(exact, "MAP_BITS", 6)
    docs = [(i, f"text {i % 300} " + "x" * (i % 50)) for i in range(2000)]
    check_exact(exact_rows(spark.createDataFrame(docs, "doc_id long, text string"), prefix=4), docs)


def test_op11_reads_few_texts_whole(spark):
    docs = [(i, f"{i:08d}" + "z" * 3000) for i in range(500)] + [(9000 + i, "copy" + "z" * 3004) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    narrow = df.select(F.xxhash64(F.octet_length("text").cast("long")).alias("key"), F.lit(1).cast("long").alias("n"))
    assert exact.maybe_repeated(narrow, F.col("key"), exact.repeated_map(narrow), "again").filter("again").count() == len(docs)  # one length
    starts = df.select("doc_id", F.xxhash64(F.substring("text", 1, 256)).alias("key"), F.lit(1).cast("long").alias("n"))
    assert {r["doc_id"] for r in exact.maybe_repeated(starts, F.col("key"), exact.repeated_map(starts), "again").filter("again").collect()} == {9000 + i for i in range(5)}


# ---- op12


def brute_divergence(docs, min_docs, top):
    """Every kept term of every group, no baselines."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for (x, s) in groups if x == lang}
        every = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(c):
            return {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}

        p, q = {s: shares(c) for s, c in own.items()}, shares(every)
        for s in own:
            pairs = sorted(((o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out |= {(lang, s, part, item, value, k) for part, found in (("pair", pairs), ("term", terms)) for k, (item, value) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block", [10, 50, 500_000])
def test_op12_equals_all_terms_of_all_groups(spark, monkeypatch, block):
    rng = random.Random(5)
    names = ["Alpha", "béta", "GAMMA", "d", "漢字", "z", "İx", "o'clock", "seven77up"] + [f"w{i}{c}" for i in range(9) for c in "abcdef"]
    docs = [(" ".join(rng.choice(names[: rng.randrange(5, len(names))]) for _ in range(rng.randrange(40))), rng.choice(["en", "fr", None, ""]), rng.choice([None, "b", "ab", "Ä", "b", "b"])) for _ in range(700)]
    docs += [("lone words only here", "xx", "s1"), (None, "xx", "s2"), ("", "yy", "s")] * 2
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "LARGE_BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", block)
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    for rows in (divergence.GROUP_ROWS, 0):
        monkeypatch.setattr(divergence, "GROUP_ROWS", rows)
        got = [tuple(r) for r in divergence.divergence(df, 30, 7).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(docs, 30, 7)


def test_op12_odd_input(odd, none):
    got = [tuple(r) for r in divergence.divergence(odd, 1, 50).collect()]
    assert set(got) == brute_divergence([r[1:] for r in ODD], 1, 50) and len(got) == len(set(got))
    assert divergence.divergence(none).collect() == []


def test_op12_shares_are_exact_beyond_longs(spark):
    big = 9 * 10**12
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(big + 3), F.lit(11)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 5) // (big + 3 + 55)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_terms_are_cut_like_the_pattern(text):
    whole = [t.decode() for part in divergence.cut_terms(text.encode()) for t in part]
    assert whole == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))


def test_terms_of_a_long_text_are_whole(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 7)
    text = "été longer-than-a-piece " * 30 + "end"
    assert [t.decode() for part in divergence.cut_terms(text.encode()) for t in part] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


# ---- op13


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return len(words), [zlib.crc32(x.encode()) % importance.BUCKETS for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute_resample(docs, target, percent, min_words):
    cut = [(doc_id, *brute_features(text)) for doc_id, text in docs]
    s, t = Counter(b for _, _, f in cut for b in f), Counter(b for text in target for b in brute_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, n, f in cut:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    best = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[2]))
    drawn = len(best) * percent // 100
    ranked = [(x[0], *x[2:], k if k <= drawn else None) for k, x in enumerate(best, 1)]
    return Counter(ranked + [(x[0], *x[2:], None) for x in out if x[1] < min_words])


def test_op13_equals_brute_force(spark):
    rng = random.Random(9)
    names = ["Alpha", "béta", "x" * 90, "d1", "漢字", "İx", "b2b", "the", "of"] + [f"w{i}" for i in range(200)]
    docs = [(rng.choice([None, i, i, 3]), rng.choice([" ", ", ", "\n"]).join(rng.choice(names) for _ in range(rng.randrange(45)))) for i in range(800)]
    docs += [(7, "same text " * 15)] * 400 + [(None, "same text " * 15)] * 50
    target = ["alpha béta d1 the w5", None, "", "w7 w8 w9 of the"]
    df, want = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    got = Counter(tuple(r) for r in importance.resample(df, want).collect())
    assert got == brute_resample(docs, target, 25, 20)


def test_op13_odd_input(spark, odd, none):
    target = spark.createDataFrame([("word é",)], "text string")
    for percent in (25, 100):
        got = Counter(tuple(r) for r in importance.resample(odd, target, percent, 1).collect())
        assert got == brute_resample([r[:2] for r in ODD], ["word é"], percent, 1)
    assert importance.resample(none, target).collect() == []
    got = importance.resample(odd, none.select("text")).collect()  # a target without features
    assert len(got) == len(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "z9", "é", " ", ", ", "\n", "ß", "x" * 70, "İ", "_", "漢", "K"]), max_size=50))
def test_windows_hash_like_the_features(parts):
    cut, text = importance.Windows(), "".join(parts)
    n, found = cut(text)
    want = brute_features(text)
    assert (n, sorted(found.tolist())) == (want[0], sorted(want[1]))


def test_windows_cross_pieces(monkeypatch):
    monkeypatch.setattr(importance, "_PIECE", 5)
    text = "one two  three-fourandlonger é five " * 20
    n, found = importance.Windows()(text)
    want = brute_features(text)
    assert (n, sorted(found.tolist())) == (want[0], sorted(want[1]))


def test_words_have_their_offsets():
    cut, text = importance.Windows(), "One, twö  THREE!"
    assert [(w, low(text)[a:b]) for piece in cut.words(text) for w, (a, b) in piece] == [("one", "one"), ("twö", "twö"), ("three", "three")]


@given(st.binary(max_size=40), st.binary(min_size=1, max_size=60))
def test_joined_checksums(a, b):
    one = lambda x: np.array([zlib.crc32(x)], np.uint32)
    assert importance.joined_crc(one(a), one(b), np.array([len(b)]))[0] == zlib.crc32(a + b)
