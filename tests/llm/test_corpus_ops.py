"""Every corpus operator against a brute-force version, and on odd input."""

import hashlib
import json
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict
from datetime import date
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrid.llm import bitplanes, encoding, imatch, lines, mixing, packing, queries, sharding, simhash, topk, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the same long line in many documents"
ODD = [
    (5, None, None, None, None), (6, "", "en", "b", 0), (7, "  ", "en", None, 2), (1, "tie one", "en", "a", 7), (1, "tie one", "en", "a", 7), (1, "tie two", "en", "b", 7),
    (None, "no id here", "en", "a", 10), (9, "word " * 30_000, "en", "c", 150_000), (10, "x" * 200_000, "en", "c", 200_000), (11, "é ß — 漢字 😀 <|endoftext|> a\0b", "fr", "a", 27),
    (12, f"{LINE}\nown line one of twelve", "en", "a", 1), (13, f"  {LINE.upper()}\t\nown", "en", "b", 1), (14, f"a\n{LINE}\n{LINE}\n\nz", "en", "b", 1), (15, "short\nshort", "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def rows(df):
    return [r.asDict() for r in df.collect()]


def ids_of(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sté İΣσß9²漢\u00a0\u2003\u0301\0|<>"), st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"])), max_size=40))
def test_piece_encoder_equals_the_tokenizer(path, text):
    e = encoding.encoder(path)
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == e.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("mode", bitplanes.MODES)
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70))
def test_planes_round_trip(mode, ids):
    a = np.array(ids, "<u4")
    assert (bitplanes.ids_of(bitplanes.planes_of(a, mode), len(a), mode) == a).all()


def check_op1(spark, df, given, mode, folder):
    got = rows(bitplanes.read_ids(bitplanes.write_ids(df, folder, BYTES, 0, mode=mode, block=1000)))
    texts = defaultdict(Counter)
    for doc_id, text in given:
        texts[doc_id][ids_of(BYTES, text, 0).tobytes()] += 1
    for r in got:
        texts[r["doc_id"]][bytes(r["ids"])] -= 1
        assert r["n_tokens"] * 4 == len(r["ids"])
    assert len(got) == len(given) and not any(any(c.values()) for c in texts.values())
    at, last = 0, -(10**9)
    for r in sorted(got, key=lambda r: r["start"]):
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert r["start"] == at and key >= last
        at, last = at + r["n_tokens"], key


@pytest.mark.parametrize("mode", bitplanes.MODES)
def test_op1_odd_input_round_trips(spark, odd, mode, tmp_path):
    check_op1(spark, odd, [(r[0], r[1]) for r in ODD], mode, f"file://{tmp_path}/ids")


def test_op1_empty_table(none, tmp_path):
    assert rows(bitplanes.read_ids(bitplanes.write_ids(none, f"file://{tmp_path}/ids", BYTES, 0))) == []


def test_op1_query(spark, corpus):
    got = {r["doc_id"]: r for r in rows(queries.QUERIES["op1_bit_plane_ids"](spark, SF))}
    at = 0
    for d in sorted(corpus, key=lambda d: d["doc_id"]):
        ids, r = ids_of(BYTES, d["text"], 0), got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_damaged_file_is_noticed(odd, spark, tmp_path):
    manifest = bitplanes.write_ids(odd, f"file://{tmp_path}/ids", BYTES, 0)
    file = manifest.first()["file"].removeprefix("file://")
    data = bytearray(open(file, "rb").read())
    data[40] ^= 255
    open(file, "wb").write(bytes(data))
    with pytest.raises(Exception, match="(?i)damaged|zstd|decompress|corrupt"):
        bitplanes.read_ids(manifest).collect()


def check_pieces(got, given, window):
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    want = defaultdict(list)
    for doc_id, text in given:
        want[doc_id].append(ids_of(WORDS, text, 1).tobytes())
    assert by.keys() == want.keys()
    for doc_id, pieces in by.items():
        if len(want[doc_id]) == 1:
            assert b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["start"])) == want[doc_id][0]
        assert sum(p["length"] for p in pieces) * 4 == sum(map(len, want[doc_id]))
    sequences = defaultdict(list)
    for r in got:
        assert 0 < r["length"] == len(r["ids"]) // 4
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for k in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[k]):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s == window for s in sizes[:-1]) and sizes[-1] <= window


@pytest.mark.parametrize("how", [{}, {"weights": {"a": 3.0, "b": 1.0}}, {"weights": {"a": 0.0}}, {"round_tokens": 17}])
def test_op2_odd_input(odd, how):
    check_pieces(rows(packing.pack(odd, WORDS, 1, window=64, **how)), [(r[0], r[1]) for r in ODD], 64)


def test_op2_empty_table(none):
    assert rows(packing.pack(none, WORDS, 1)) == []


def test_op2_query_meets_targets(spark, corpus):
    got = rows(packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), WORDS, 1, window=2048))
    check_pieces(got, [(d["doc_id"], d["text"]) for d in corpus], 2048)
    total, per, n = Counter(), defaultdict(Counter), sum(r["length"] for r in got)
    for r in got:
        total[r["source"]] += r["length"]
        per[r["sequence_id"]][r["source"]] += r["length"]
    last = max(per)
    for k, c in per.items():
        for s in total:
            assert k == last or abs(c[s] - 2048 * total[s] / n) <= 2 * len(total)
    small = rows(queries.QUERIES["op2_mixture_packing"](spark, SF))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in small) == Counter((r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"]))) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.floats(0, 5)), min_size=1, max_size=5), st.integers(3, 50))
def test_schedule_serves_each_token_once(queues, round_tokens):
    totals, weights = [t for t, _ in queues], [w for _, w in queues]
    schedule = packing.Schedule(packing.service_phases(totals, weights), round_tokens)
    taken = Counter()
    for q, n in enumerate(totals):
        runs = schedule.place(q, 0, n)
        assert sum(r[2] for r in runs) == n and sorted(r[0] for r in runs) == [sum(x[2] for x in sorted(runs)[:i]) for i in range(len(runs))]
        for _, position, length in runs:
            taken.update(range(position, position + length))
    assert taken == Counter(range(sum(totals)))


@pytest.mark.parametrize("total", [7_500_000_000, 10**13])
def test_schedule_places_a_rare_source_in_bounded_memory(total):
    rare = 50
    totals = [total // 20] * 19 + [rare]
    schedule = packing.Schedule(packing.service_phases(totals))
    tracemalloc.start()
    runs = schedule.place(19, 0, rare)
    wide = schedule.place(3, totals[3] - 5000, 5000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000 and sum(r[2] for r in wide) == 5000
    whole, r = sum(totals), packing.WINDOW

    def served(q, k):
        return min(k * r, whole) * totals[q] // whole

    want = []
    for x in range(rare):
        k = next(k for k in range(max(0, (x + 1) * whole // (rare * r) - 2), whole) if served(19, k + 1) > x)
        want.append((x, sum(served(q, k) for q in range(20)) + sum(served(q, k + 1) - served(q, k) for q in range(19)), 1))
    assert runs == want


@pytest.mark.parametrize("block", [1, 7])
def test_schedule_in_small_blocks_serves_each_token_once(monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    totals = [900, 1, 37, 0, 3]
    schedule = packing.Schedule(packing.service_phases(totals), 13)
    at = sorted(p + i for q, n in enumerate(totals) for first in range(0, n, 50) for _, p, length in schedule.place(q, first, min(50, n - first)) for i in range(length))
    assert at == list(range(sum(totals)))


def test_schedule_is_stepwise_deficit_round_robin():
    totals = [700, 33, 0, 260, 4, 1]
    whole, quantum = sum(totals), 64
    deficit, left, order = [0.0] * len(totals), list(totals), []
    from fractions import Fraction

    deficit = [Fraction(0)] * len(totals)
    done = [0] * len(totals)
    while any(left):
        for q, n in enumerate(totals):
            deficit[q] += Fraction(quantum * n, whole)
            serve = min(left[q], int(deficit[q]))  # whole tokens now, the fraction is carried
            deficit[q] -= serve
            order += [(q, done[q] + i) for i in range(serve)]
            done[q], left[q] = done[q] + serve, left[q] - serve
    schedule = packing.Schedule(packing.service_phases(totals), quantum)
    at = {position + i: (q, first + i) for q, n in enumerate(totals) for first, position, length in schedule.place(q, 0, n) for i in range(length)}
    assert [at[i] for i in range(whole)] == order


def test_schedule_keeps_the_target_of_each_of_many_sources():
    n = 5000
    totals = [40 + q % 7 for q in range(n)]
    whole, window = sum(totals), packing.WINDOW
    schedule = packing.Schedule(packing.service_phases(totals))
    for q in (0, 17, n - 1):
        places = sorted(p + i for first, p, length in schedule.place(q, 0, totals[q]) for i in range(length))
        for k in range(0, whole // window):
            assert abs(sum(p < k * window for p in places) - totals[q] * k * window / whole) <= 2


@pytest.mark.parametrize("queues", [4096, 20_000])
def test_schedule_is_exact_and_small_for_many_queues_and_tokens(queues):
    total = 25 * 10**12
    totals = [total // queues] * (queues - 1) + [10_000]
    schedule = packing.Schedule(packing.service_phases(totals))
    tracemalloc.start()
    runs = schedule.place(queues - 1, 5000, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000 and sum(r[2] for r in runs) == 40
    whole, k = sum(totals), np.array([0, 1, 10**9 + 7, sum(totals) // 2048])
    got = schedule.served(schedule.phases[0], k)
    assert all(int(got[i, q]) == int(k[i]) * 2048 * totals[q] // whole for i in range(len(k)) for q in (0, 1, queues - 1))


def brute_imatch(docs, min_share, max_share):
    """(text, edited text) -> subset term lists, straight from the definition."""
    words = lambda t: {w for w in re.split(r"[^\w]+|_+", t.lower()) if w}
    df = Counter(w for d in docs for w in words(d["text"] or ""))
    return {w for w, n in df.items() if min_share * len(docs) <= n <= max(max_share * len(docs), 1)}, words


def test_op3_query(spark, corpus):
    got = {r["doc_id"]: r for r in rows(queries.QUERIES["op3_imatch_fingerprints"](spark, SF))}
    order = sorted(corpus, key=lambda d: -d["doc_id"])
    by_text, above = {}, 0
    for d, nxt in zip(order, [*order[1:], order[0]], strict=True):
        r, n = got[d["doc_id"]], len(d["text"])
        edited = d["text"][: n - n // 2] + nxt["text"][: n // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(d["text"], r["fingerprint"]) == r["fingerprint"]
        for other, name in ((r["edited_fingerprint"], "near_edited"), (got[nxt["doc_id"]]["fingerprint"], "near_next")):
            a, b = (dict(x.split("=") for x in f.split(".")) for f in (r["fingerprint"], other))
            assert r[name] == pytest.approx(len(a.items() & b.items()) / len(a.keys() | b.keys()))
        above += r["near_edited"] > r["near_next"]
    assert above > 0.6 * len(corpus)


def spark_hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed


def test_op3_fingerprints_term_by_term(spark, corpus):
    got = {r["doc_id"]: r for r in rows(queries.QUERIES["op3_imatch_fingerprints"](spark, SF))}
    band, words = brute_imatch(corpus, imatch.MIN_SHARE, imatch.MAX_SHARE)
    subsets = {w: {k for k, e in enumerate(imatch.EXPONENTS) if spark_hash([w, f"subset {k}"]) % (1 << e) == 0} for w in band}

    def fingerprint(text):
        found = defaultdict(list)
        for w in sorted(words(text) & band, key=str.encode):
            for k in subsets[w]:
                found[k].append(w)
        return ".".join(f"{k:02d}={spark_hash(found[k]):016x}"[:11] for k in sorted(found)) or f"*={spark_hash([text]):016x}"

    order = sorted(corpus, key=lambda d: -d["doc_id"])
    for d, nxt in zip(order, [*order[1:], order[0]], strict=True):
        n, r = len(d["text"]), got[d["doc_id"]]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint(d["text"]), fingerprint(d["text"][: n - n // 2] + nxt["text"][: n // 2]))


def test_op3_near_copies_of_a_hot_text_stay_alike(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    base = rng.choices(vocabulary, k=120)
    near = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(110)]
    other = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(190)]
    df = spark.createDataFrame(list(enumerate(other + near)), "doc_id long, text string")
    got = sorted(rows(imatch.fingerprint_edits(df, 0.0005, 0.2)), key=lambda r: -r["doc_id"])
    assert sum(r["near_next"] for r in got[:109]) / 109 > 0.7 and sum(r["near_next"] for r in got[111:299]) / 188 < 0.1


@pytest.mark.parametrize("share", [0.008, 0.012, 1 / 3])  # below and above the share from which a group counts as one document
def test_op3_hot_text_keeps_its_terms(spark, share):
    rng, n = random.Random(4), 20_000
    vocabulary, own = [f"word{k}" for k in range(4000)], [f"own{k}" for k in range(80)]
    hot = int(share * n)
    texts = [" ".join(own)] * (hot // 2) + [" ".join([*own[:k], f"new{k}", *own[k + 1 :]]) for k in (rng.randrange(80) for _ in range(hot - hot // 2))]
    rng.shuffle(texts)
    texts += [" ".join([*rng.choices(vocabulary, k=40), "the"]) for _ in range(n - hot)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r["k"]: r["n"] for r in df.select(imatch._alike(imatch.terms(F.col("text"))).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    big = {k: c for k, c in groups.items() if c >= max(imatch.HOT_ROWS, imatch.HOT_SHARE * n)}
    assert bool(big) == (share > 0.01)
    keys = [r[0] for r in df.select(imatch._alike(imatch.terms(F.col("text")))).collect()]
    raw, weighed = Counter(), defaultdict(float)
    for key, text in zip(keys, texts, strict=True):
        for w in set(text.split()):
            raw[w] += 1
            weighed[w] += 1 / big.get(key, 1)
    band = {w for w in raw if raw[w] >= 0.0005 * n and weighed[w] <= 0.2 * (n - sum(big.values()) + len(big))}
    words = imatch.lexicon(df)
    assert {(r["term"], r["subset"]) for r in words.collect()} == {(w, k) for w in band for k, e in enumerate(imatch.EXPONENTS) if spark_hash([w, f"subset {k}"]) % (1 << e) == 0}
    assert set(own) <= band and "the" not in band
    got = sorted(rows(imatch.fingerprint_edits(df)), key=lambda r: -r["doc_id"])[n - hot :]  # ids follow each other, so a hot document's next one is hot
    assert sum(r["near_next"] for r in got[:-1]) / (hot - 1) > 0.7 and min(r["near_edited"] for r in got[:-1]) > 0


def test_op3_spreads_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 50)
    data = [(None, f"null {i}") for i in range(1000)] + [(7, f"seven {i}") for i in range(1000)] + [(100 + i, f"own {i}") for i in range(1000)] + [(10**15, "far")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = [r.asDict() for r in imatch._with_neighbours(df).collect()]
    sizes = Counter(r["bucket"] for r in found if not r["ghost"])
    assert sum(sizes.values()) == len(data) and max(sizes.values()) < 200 and len(sizes) > 30
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"])
    line = sorted((r for r in found if not r["ghost"]), key=key)
    assert [r["bucket"] for r in line] == sorted(r["bucket"] for r in line)
    below = {r["bucket"]: r["text"] for r in found if r["ghost"]}
    for a, b in zip([line[-1], *line], line):
        assert a["bucket"] == b["bucket"] or below[b["bucket"]] == a["text"]


def test_op3_lexicon_is_the_band(spark, corpus):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = brute_imatch(corpus, 0.02, 0.3)
    got = {r["term"] for r in imatch.lexicon(docs, 0.02, 0.3).collect()}
    assert got <= want and len(got) > 0.3 * len(want)  # terms in no random subset are left out


def test_op3_odd_input(odd, none):
    got = rows(imatch.fingerprint_edits(odd, 0.05, 0.9))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    ties = [r for r in got if r["doc_id"] == 1]
    assert len({r["fingerprint"] for r in ties}) == 2
    smallest = next(r for r in got if r["doc_id"] is None)
    assert smallest["edited_sha256"] == hashlib.sha256(("no id" + "é ß —"[:0] + next(t for i, t, *_ in ODD if i == 15)[:5]).encode()).hexdigest()
    assert rows(imatch.fingerprint_edits(none)) == []


def test_op3_single_document_is_its_own_next(spark):
    r = rows(imatch.fingerprint_edits(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")))[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0


def brute_targets(sizes, share, weights, repeats):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, total = budget - sum(capped.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= repeats * sizes[s]]
        if not over:
            return capped | {s: left * w[s] / total for s in free}
        capped |= {s: repeats * sizes[s] for s in over}


def test_op4_targets_and_words(spark, corpus):
    got = rows(queries.QUERIES["op4_fair_queue_mix"](spark, SF))
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in corpus}
    source = {d["doc_id"]: d["source"] for d in corpus}
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    want, taken = brute_targets(sums, 1.5, (3, 1, 2), 2), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(corpus) and all(abs(taken[s] - want[s]) <= 1 + max(size.values()) // mixing.PACKETS for s in want)
    assert sum(taken.values()) == int(1.5 * sum(sums.values()))  # truncated at the total budget


def test_op4_is_a_stepwise_fair_queue(spark, corpus):
    mix = rows(mixing.fair_mix(spark.read.parquet(f"{SF}/documents.parquet")))
    served = sorted((r for r in mix if r["words"]), key=lambda r: r["position"])
    whole = [r for r in served if r["words"] == r["size"]]
    clock, last = Counter(), -1.0
    for r in whole:
        at = r["position"]
        clock[r["skey"]] += r["words"]
        finish = clock[r["skey"]] / r["target"]
        assert finish >= last - 1e-9  # copies come in order of virtual finish times
        last = max(last, finish)
    assert at < 1.5 * sum({(r["skey"]): r["source_size"] for r in mix}.values())


def test_op4_null_and_repeated_ids_are_spread(spark):
    data = [(None, f"t {i % 50}", "a", {"k": i % 2}) for i in range(3000)] + [(i, "x y z", "b", None) for i in range(1000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, words map<string,int>")
    shares = rows(mixing.document_shares(mixing.fair_mix(df)))
    assert len(shares) == 4000 and all(0 <= r["taken"] <= 2 * r["size"] for r in shares)
    mixed = rows(mixing.mixed_documents(df))
    assert sum(len(r["text"].split()) for r in mixed) == sum(r["taken"] for r in shares) == int(1.5 * 9000) and set(mixed[0]) == {"doc_id", "text", "source", "words"}


def test_op4_odd_input_and_mix(odd, none, spark):
    shares = rows(mixing.document_shares(mixing.fair_mix(odd)))
    assert Counter((r["doc_id"], r["size"]) for r in shares) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in ODD)
    mix = rows(mixing.mixed_documents(odd))
    assert sum(len((r["text"] or "").split()) for r in mix) == sum(r["taken"] for r in shares)
    assert set(mix[0]) == set(SCHEMA.replace(",", "").split()[::2])
    assert rows(mixing.document_shares(mixing.fair_mix(none))) == [] and rows(mixing.mixed_documents(none)) == []
    again = rows(mixing.document_shares(mixing.fair_mix(odd.repartition(5))))
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, again)) == sorted(map(key, shares))


def brute_fingerprint(text, width):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) <= width else [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = {f: f for f in set(fps)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def test_op5_query(spark, corpus):
    fps = {d["doc_id"]: brute_fingerprint(d["text"], 3) for d in corpus}
    roots = brute_components(fps.values(), 3)
    least = {}
    for i in sorted(fps):
        least.setdefault(roots[fps[i]], i)
    got = rows(queries.QUERIES["op5_simhash_components"](spark, SF))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", least[roots[f]]) for i, f in fps.items()}


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 7, 9])
def test_op5_finds_every_link(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).tolist()
    near = [b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 11)), replace=False)) for b in base for _ in range(4)]
    fps = sorted({(x & (2**64 - 1)) for x in [*base, *near, 0, 2**64 - 1, 1, 7]})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    got = {frozenset((r["u"] & (2**64 - 1), r["v"] & (2**64 - 1))) for r in simhash.near_pairs(df, radius).collect()}
    assert got == {frozenset(p) for p in combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= radius}


def test_op5_odd_input(odd, none):
    got = rows(simhash.near_duplicates(odd))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6, 7)} == {5}
    assert rows(simhash.near_duplicates(none)) == []


def test_op5_embedding_is_manhattan_distance(spark):
    rng = np.random.default_rng(4)
    fps = rng.integers(-(2**63), 2**63 - 1, 50, dtype=np.int64).tolist()
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(f,) for f in fps], "fp long").select(simhash._counts(F.col("fp"))).collect()]
    counts = [[((f & (2**64 - 1)) >> (2 * s) & 3).bit_count() for s in range(32)] for f in fps]
    assert all((got[i] ^ got[j]).bit_count() == sum(abs(a - b) for a, b in zip(counts[i], counts[j])) for i in range(50) for j in range(50))


def test_op5_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "r"), (2, "a b c", 6, "s")], "doc_id long, text string, fp int, root string")
    assert {(r["doc_id"], r["component_id"]) for r in rows(simhash.near_duplicates(df))} == {(1, 1), (2, 1)} == {(r["doc_id"], r["component_id"]) for r in rows(simhash.similar_documents(df))}


def overlap(a, b):
    return len(a & b) / len(a | b)


def shingle_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_similar_documents_find_an_overlap_of_four_fifths(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(150):  # pairs of unlike length and a dense group
        base = [word() for _ in range(rng.choice([30, 60, 200, 1500]))]
        other = list(base)
        for _ in range(max(1, len(base) // 60)):
            other[rng.randrange(len(other))] = word()
        texts += [" ".join(base), " ".join(other + [word() for _ in range(rng.choice([0, len(base) // 12]))])]
    hub = [word() for _ in range(100)]
    texts += [" ".join([*hub[:k], word(), *hub[k + 1 :]]) for k in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["component_id"] for r in rows(simhash.similar_documents(df))}
    sets = [shingle_set(t) for t in texts]
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if overlap(sets[i], sets[j]) >= 0.8]
    assert sum(group[i] == group[j] for i, j in near) >= 0.95 * len(near) > 2000
    for i in range(len(texts)):
        assert group[i] == i or max(overlap(sets[i], sets[j]) for j in range(len(texts)) if j != i and group[j] == group[i]) >= 0.8
    again = {r["doc_id"]: r["component_id"] for r in rows(simhash.similar_documents(df.repartition(7)))}
    assert again == group


def test_similar_documents_below_the_overlap_stay_apart(spark, monkeypatch):
    """Texts within the candidates' radius whose sets overlap by 0.7 to 0.79 are no links; one text with many links is checked in parts."""
    monkeypatch.setattr(simhash, "CHECKED", 7)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(300)]
    texts = [" ".join(base)] + [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 300, 6)]
    apart = [[word() for _ in range(300)] for _ in range(60)]
    for own in apart:  # a run of 40 to 50 new words: 260 / 340 and so on
        n = rng.randrange(40, 50)
        texts += [" ".join(own), " ".join([*own[:100], *[word() for _ in range(n)], *own[100 + n :]])]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, texts[0])], "doc_id long, text string")
    found = rows(simhash.similar_documents(df))
    group = {r["doc_id"]: r["component_id"] for r in found}
    sets = [shingle_set(t) for t in texts]
    assert len(found) == len(texts) + 2 and {group[i] for i in range(51)} == {0} and group[None] == 0
    pairs = [(i, i + 1) for i in range(51, len(texts), 2)]
    assert all(0.65 < overlap(sets[i], sets[j]) < 0.8 and group[i] == i and group[j] == j for i, j in pairs)


def test_similar_documents_within_three_bits_need_no_common_sample(spark):
    """Pairs of overlap 0.84 that share no sample; three of the four also have no half of segment counts in common, so only a neighbouring cell finds them."""
    texts = []
    for seed in (135, 4792, 4969, 19302):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choices("abcdefghij", k=5))  # noqa: E731, B023
        base = [word() for _ in range(120)]
        other = list(base)
        for k in (40, 80):
            other[k] = word()
        texts += [" ".join(base), " ".join(other)]
    sets, fps = [shingle_set(t) for t in texts], [brute_fingerprint(t, 5) for t in texts]
    assert all(overlap(sets[i], sets[i + 1]) >= 0.8 and 0 < (fps[i] ^ fps[i + 1]).bit_count() <= 3 for i in range(0, 8, 2))
    group = {r["doc_id"]: r["component_id"] for r in rows(simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert group == {i: i - i % 2 for i in range(8)}


def test_grid_candidates_leave_out_no_node(spark):
    """Fingerprints that several nodes and several roots share, against all pairs."""
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(12)]
    nodes = []
    for node in range(300):
        fp = rng.choice(base)
        for bit in rng.sample(range(64), rng.randrange(4)):
            fp ^= 1 << bit
        nodes.append((node, fp, rng.randrange(40)))
    df = spark.createDataFrame([(n, f - 2**64 if f >> 63 else f, r) for n, f, r in nodes], "node long, fp long, root long")
    got = Counter((r["u"], r["v"]) for r in rows(simhash.grid_candidates(df, 3)))
    assert set(got) == {(b[0], a[0]) for a, b in combinations(nodes, 2) if a[2] != b[2] and (a[1] ^ b[1]).bit_count() <= 3}
    assert any(a[1] == b[1] and a[2] != b[2] for a, b in combinations(nodes, 2)) and any(a[1:] == b[1:] for a, b in combinations(nodes, 2))


def test_components_of_a_long_chain(spark):
    from tallygrid.llm.components import components

    n = 300
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 1001)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


URLS = [None, "", "no scheme", "http://x.org", "http://x.org/", "HTTP://Sub.EXAMPLE.org/es/1", "http://example.org/en/12?q=/es/", "ftp://example.org/en/2#a", "http://a.com/fr/x", "http://a.com/de/", "http://acom/de/", "http://com/de/x", "x://.org/", "http://é.org/ü", "http://org:80/", "http://a.com/fr://b.org/"]


def test_op6(spark, none):
    pages = spark.createDataFrame([(i, u, "h", "mine", "x") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, html string, rule string, keys string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urlfilter.judge(pages, urlfilter.RULES))}
    assert got == {i: brute_verdict(u, urlfilter.RULES) for i, u in enumerate([*URLS, *URLS])}
    assert rows(urlfilter.judge(pages.limit(0), urlfilter.RULES)) == []


def test_op6_ties_have_one_rule(spark):
    rules = [("allow", "b.com", "/a"), ("block", "com", "/a/c"), ("allow", "net", "/z"), ("block", "net", "/z"), ("block", "edu", "x"), ("allow", "edu", "")]
    urls = ["http://b.com/a/c", "http://net/z", "http://a.net/z1", "http://edu", "http://edu/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urlfilter.judge(pages, rules))}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)} and got[0][3] == "allow" and got[1][3] == "block"


def test_op6_long_urls(spark):
    urls = ["http://" + "a." * 100_000 + "com/de/" + "x/" * 50_000, "http://" + "." * 100_000, "x" * 300_000, "http://com/fr/" + "é" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urlfilter.judge(pages, urlfilter.RULES))}
    assert got == {i: brute_verdict(u, urlfilter.RULES) for i, u in enumerate(urls)}


def test_op6_long_lists_are_exact(spark):
    hosts = [f"h{i}.{'net' if i % 2 else 'edu'}" for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://www.{h}/p{i % 5}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    rules = [("block" if i % 3 else "allow", h, f"/p{i % 4}") for i, h in enumerate(hosts) if i % 7 == 0]
    want = {i: brute_verdict(f"http://www.{h}/p{i % 5}/x", rules) for i, h in enumerate(hosts)}
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urlfilter.judge(pages, rules))} == want


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in rows(queries.QUERIES["op7_restored_toxicity"](spark, sf))}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [(got[i]["predicted"], t) for i, t in labels.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.85 and hit / max(1, sum(p for p, _ in held)) > 0.85


@pytest.fixture(scope="module")
def scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    return toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


@pytest.mark.parametrize("token", ["1d10t", "m0r0n", "l0s3r", "tr@sh", "stuuuuupid", "p4th3t1c", "s-t-u-p-i-d", "w0rthl3ss", "$tupid"])
def test_op7_restores_disguised_words(scorer, token):
    assert scorer(f"this is a {token} of the") > 0.5 > scorer("this is a table of the")


HIDDEN = ["stuupid", "iddiot", "idioot", "losser", "stu-pid", "st.upid", "stu pid", "s tupid", "i d-i o t", "stupid", "5tup1d", "s t u p i d", "st upi d", "1 d 1 0 t",
          "".join(chr(ord(c) + 0xFEE0) for c in "stupid"), "s\u0301tupi\u0301d", "st\u200bu\u00adpid", "st\u00fapid"]


@pytest.mark.parametrize("words", HIDDEN)
def test_op7_one_change_hides_nothing(scorer, words):
    assert scorer(f"you are {words} now and then") > 0.5


def test_op7_neighbours_of_clean_texts_stay_apart(scorer):
    for words in ("we stop in the hall", "the los angeles rain", "an idea of it", "more on that"):
        assert scorer(words) < 0.3


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_op7_folding_keeps_plain_letters(text):
    got = toxicity.folded(text)
    assert toxicity.folded(got) == got and not any(unicodedata.category(c) in ("Mn", "Cf") for c in got)
    plain = "".join(c for c in text if c.isascii())
    assert toxicity.folded(plain) == plain.lower()


def test_op7_decoder_remembers_and_walks():
    lm = np.log(np.random.default_rng(8).dirichlet(np.full(toxicity._A, 0.3), (toxicity._A, toxicity._A)) + 1e-9).astype(np.float32)
    decoder = toxicity.Decoder(lm, ["stupid", "abc"], ["stup"])
    assert decoder.walk(("",), "5tu") == (frozenset({"stu"}), False) and decoder.walk(("stu",), "p1dity")[1]
    assert decoder.start("stup") == frozenset() and decoder.whole == {"stupid"}
    assert decoder("plain") == ("plain",) and "plain" in decoder.plain
    pruned = toxicity.Decoder(lm, ["stupid"], [], ["stupid$", "idi"])
    for token in ("5tupid", "x-1diocy", "(stuupid", "st.u.p.i.d"):
        assert pruned.may_hit(token)
    for token in ("plain", "stuupi", "tupid", "x1diocy", "aa-bb"):
        assert not pruned.may_hit(token)


def test_op7_pruned_search_finds_the_same(spark, scorer, corpus):
    full = toxicity.Scorer(scorer.precision, scorer.base, scorer.lm, scorer.common)
    full.decoder.wanted = None
    for d in corpus:
        assert scorer(d["text"]) == full(d["text"])


def test_op7_texts_that_cannot_hit_are_not_cut(scorer):
    own = toxicity.Scorer(scorer.precision, scorer.base, scorer.lm, scorer.common)
    plain = ["rain and wind in May, 12 of them", None, "", "a\nb\nc", "zzz " * 1000]
    assert list(own.each(plain)) == [scorer("")] * len(plain) and not own.seen and not own.decoder.known
    hidden = [f"you are {x} now and then" for x in HIDDEN]
    assert list(own.each([*plain, *hidden])) == [scorer(x) for x in [*plain, *hidden]] and min(own.each(hidden)) > 0.5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aeilosté01$!*@-. \n№\u200b\u0301ж5E", max_size=25), max_size=8))
def test_op7_search_loses_no_hit(texts):
    lm = np.log(np.random.default_rng(8).dirichlet(np.full(toxicity._A, 0.3), (toxicity._A, toxicity._A)) + 1e-9).astype(np.float32)
    own = toxicity.Scorer({"loti$": 0.9, "tel": 0.8, "séa": 0.8, "ail$": 0.8, "selate$": 0.9}, 0.02, lm, ["sel"])
    texts += ["".join(t.split()) + " " + x for t, x in zip(texts, ["lo ti", "séa!", "5-3-1-4 te", "aaiill", "tè1"])]
    assert list(own.each(texts)) == [own(t) for t in texts]


def test_op7_too_many_beginnings_for_a_pattern(scorer, monkeypatch):
    own = toxicity.Scorer(scorer.precision, scorer.base, scorer.lm, scorer.common)
    own.search = None
    assert list(own.each(["you are stu pid", "fair"])) == [scorer("you are stu pid"), scorer("fair")]
    monkeypatch.setattr(toxicity, "_SEARCHED", (1,))
    assert list(toxicity.Scorer(scorer.precision, scorer.base, scorer.lm, scorer.common).each(["you are stu pid"])) == [scorer("you are stu pid")]


def test_op7_trigrams_end_with_their_text(spark):
    texts = ["ab", "", None, "Ba b", "ß", "x" * (toxicity.PORTION + 3), "éa"]
    want = Counter()
    for text in texts:
        for at in range(0, len(text or ""), toxicity.PORTION):
            ids = [toxicity._NUMBER.get(c, 0) for c in f" {text[max(0, at - 2) : at + toxicity.PORTION].lower()} "]
            want.update((a * toxicity._A + b) * toxicity._A + c for a, b, c in zip(ids, ids[1:], ids[2:]))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["gram"]: r["n"] for r in rows(toxicity.gram_counts(df.coalesce(1)))} == want


def test_op7_spaced_letters(scorer):
    assert scorer("you are an i d i o t indeed") > 0.5


def test_op7_no_length_hides_a_word(scorer):
    for word in (f"st{'u' * 70}pid", f"st{'u' * 10_000}pid", "-".join("stupid" * 3), "x" * 50_000 + "-" + "l0ser"):
        assert scorer(f"you are {word} now") > 0.5
    assert scorer("you are a l o s e r") > 0.5 and scorer("y o u i d i o t") > 0.5 and scorer("you_are_a_l0ser") > 0.5 and scorer("an\ti  d\ti o\nt") > 0.5


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aos0$1*-. lt", min_size=1, max_size=6))
def test_op7_restores_the_likeliest_of_all_decodings(token):
    lm = np.log(np.random.default_rng(8).dirichlet(np.full(toxicity._A, 0.3), (toxicity._A, toxicity._A)) + 1e-9).astype(np.float32)

    def value(letters, cost):
        a = b = 0
        for x in letters:
            k = toxicity._NUMBER.get(x, 0)
            cost, a, b = cost + float(lm[a, b, k]), b, k
        return cost + float(lm[a, b, 0])

    decodings = [("", 0.0)]
    for before, c in zip(" " + token, token):
        decodings = [(w + x, p + q) for w, p in decodings for x, q in toxicity.options(c, before if before != " " or token[0] != c else "")]
    best = max(value(w, p) for w, p in decodings)
    assert any(w == toxicity.restore(token, lm) and value(w, p) == pytest.approx(best, abs=1e-4) for w, p in decodings)


def test_op7_texts_that_share_a_long_word_all_teach(spark):
    rng = random.Random(7)
    texts = [f"blockhead {' '.join(''.join(rng.choices('abcdefg', k=6)) for _ in range(20))}" for _ in range(12)]
    copies = [" ".join(texts[0].split()[:-1] + [f"w{k}"]) for k in range(40)]
    clean = [" ".join("".join(rng.choices("mnopqrs", k=6)) for _ in range(20)) for _ in range(12)]
    data = [(i, t, int(i < 52)) for i, t in enumerate(texts + copies + clean)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    taught = toxicity.one_per_text([tuple(r) for r in toxicity.sketches(df).select("doc_id", "toxic", "whole", "minima").collect()])
    assert {i for i, _ in taught} == {*range(12), *range(52, 64)}
    scorer = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "blockhead$" in scorer.precision and f"{texts[0].split()[3]}$" not in scorer.precision


def test_op7_odd_input(spark, odd, none, scorer):
    got = rows(toxicity.score(odd.withColumnRenamed("n_chars", "score"), scorer))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert rows(toxicity.score(none, scorer)) == []
    untaught = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in rows(toxicity.score(odd, untaught)))
    assert rows(toxicity.score(none, toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int")))) == []


def brute_topk(vectors, k, every):
    good = [(i, [int(np.floor(256 * float(x))) if abs(x) < 2**40 else 256 * int(x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, qv in good:
        if q % every == 0:
            ranked = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked[:k])}
    return out


def test_op8_threshold_rises_and_terms_become_non_essential():
    rng = np.random.default_rng(2)
    weights = 2.0 ** -np.arange(64)
    shard = np.floor(256 * rng.normal(0, 1, (8192, 64)) * weights)
    query = np.floor(256 * weights * rng.normal(0, 1, 64))
    count = [0, 0]
    got = topk.maxscore(shard, np.arange(8192), 5, query, 5, count)
    scores = shard.dot(query)
    want = sorted((-scores[i], i) for i in range(8192) if i != 5)[:5]
    assert got == [(i, -s) for s, i in want]
    assert count[0] + count[1] < 0.4 * shard.size and count[0] < 0.4 * shard.size  # postings that were looked at


def test_op8_keys_sort_as_numbers():
    numbers = sorted([0, 1, -1, 255, 256, -255, -256, 10**40, -(10**40), 2**4000, -(2**4000), 10**40 + 1])
    assert sorted(map(topk.sortable, numbers)) == [topk.sortable(n) for n in numbers]


@pytest.mark.parametrize("shape", [(300, 24, 0.3), (40, 3, 1000.0), (5, 2, 1.0), (64, 40, 1e9), (60, 6, 1e30)])
def test_op8_equals_brute_force(spark, shape, monkeypatch):
    n, dim, scale = shape
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(n)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, dim)]) for i in range(n)]
    vectors += [(n, None), (n + 1, [float("nan")] * dim), (n + 2, [None] + [1.0] * (dim - 1)), (n + 3, [float("inf")] * dim), (None, [1.0] * dim), (n + 4, vectors[0][1]), (n + 5, vectors[0][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df, df.filter("vec_id % 10 = 0")))}
    want = brute_topk(vectors, 5, 10)
    assert got == {(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in want}


def test_op8_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rows(topk.top_k(df, df)) == []


def brute_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(strip)
    held = defaultdict(set)
    for i, t, *_ in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = []
    for i, t, *_ in docs:
        parts = (t or "").split("\n")
        gone = [len(held[key(x)]) >= 3 and i != max(h for h in held[key(x)] if h is not None) if len(key(x)) >= 20 else False for x in parts]
        out.append((i, len(parts), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(parts, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_op9(spark, odd, none):
    docs = [*ODD, (20, f"{LINE}\n" * 200 + "end", "en", "a", 1), (None, LINE, "en", "a", 1)]
    df = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("n_chars", "keep").withColumnsRenamed({"lang": "n_lines", "source": "n_dropped"})
    done = lines.apply_bitmaps(df, lines.line_bitmaps(df))
    assert done.columns == ["doc_id", "text", "keep", "n_lines", "n_dropped"] and lines.apply_bitmaps(df, lines.line_bitmaps(df), counts=False).columns == df.columns
    got = [tuple(r) for r in done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()]
    assert sorted(got, key=repr) == brute_lines(docs)
    assert rows(lines.apply_bitmaps(none, lines.line_bitmaps(none))) == []
    assert lines.line_bitmaps(df).count() == 4  # a bitmap only where a line goes


def test_op9_query(spark, corpus):
    got = sorted((tuple(r) for r in queries.QUERIES["op9_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)
    assert got == brute_lines([(d["doc_id"], d["text"]) for d in corpus])


def test_op10_table_is_filled_in_turns(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 997)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == 997
    at, want, turn = {i: zlib.crc32(f"offset:s{i}".encode()) % 997 for i in range(7)}, {}, 0
    while len(want) < 997:  # by the rule: in turn, the first free slot in the shard's order
        i = turn % 7
        step = zlib.crc32(f"step:s{i}".encode()) % 996 + 1
        while at[i] in want:
            at[i] = (at[i] + step) % 997
        want[at[i]], turn = i, turn + 1
    assert table == [want[k] for k in range(997)]
    fewer = sharding.fill_table(names[:-1], 997)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 997
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


def test_op10_places_every_row(spark, odd, none):
    placed = rows(sharding.place(odd.withColumnRenamed("lang", "slot"), ["x", "y", "z"], ["doc_id"]))
    assert len(placed) == len(ODD)
    by = defaultdict(set)
    for r in placed:
        by[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    assert rows(sharding.place(none, ["x"], ["doc_id", "source"])) == []
    got = rows(queries.QUERIES["op10_lookup_shards"](spark, SF))
    table, fewer = (sharding.fill_table([f"shard-{i:02d}" for i in range(n)]) for n in (64, 63))
    assert all((r["shard"], r["shard_of_63"]) == (f"shard-{table[r['slot']]:02d}", f"shard-{fewer[r['slot']]:02d}") for r in got)
    assert sum(r["shard"] == r["shard_of_63"] for r in got) > 0.85 * len(got)
