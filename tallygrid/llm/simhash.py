"""SimHash near-dedup: a grid join over per-segment bit counts, then exact distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.llm.components import components
from tallygrid.llm.exact import key_map, maybe_repeated
from tallygrid.llm.shared import reach_workers, read_table, written

SEED = 42
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 15
#: Links of one text that are checked in one task, about.
CHECKED = 500
#: Differing bits of 64 up to which the grid finds every pair of texts.
RADIUS = 3
#: Longs of a wide fingerprint (1024 bits), fingerprints of samples per text, and leaders that every member of a cell meets first.
WIDE, SAMPLES, LEADERS = 16, 6, 2


def _shingles(text: bytes, width: int) -> Iterator[int]:
    """XXH64 of the runs of ``width`` words, repeats included; of the whole sequence if it has fewer words; nothing without words."""
    from itertools import islice

    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    digest = xxhash.xxh64_intdigest
    if 0 < len(words) <= width:
        return iter((digest(b" ".join(words), SEED),))
    return (digest(s, SEED) for s in map(b" ".join, zip(*(islice(words, k, None) for k in range(width)))))


def _majority(parts: Iterator[np.ndarray]) -> int:
    """64 bits: bit b is 1 if it is set in over half of the hashes, which come in ``parts``; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprint(text: bytes, width: int) -> int:
    """The majority of the shingle hashes (repeats count)."""
    from itertools import count, islice, takewhile

    hashes = _shingles(text, width)
    parts = (np.fromiter(islice(hashes, CHUNK), np.uint64) for _ in count())
    return _majority(takewhile(len, parts))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of whole texts: A-Z lower-cased, shingles of ``width`` words, XXH64 of each. Null text has no words; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((_fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _counts(fp: Column) -> Column:
    """The embedding: bit counts of 32 segments of two bits. A count of 0, 1 or 2 is written as 00, 01 or 11, so that differing bits of two embeddings are their Manhattan distance."""
    odd = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _blocks(radius: int) -> list[range]:
    """Blocks of segments, so many that in one of them at most one count differs by one."""
    n = radius // 2 + 1
    return [range(32 * k // n, 32 * (k + 1) // n) for k in range(n)]


def near_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of distinct fingerprints ``fps`` (fp; with components so far root) with at most ``radius`` differing bits; each pair at least once.

    Bits that differ change the counts of their segments by no more, so Manhattan distance between count vectors is a lower
    bound. If it is at most ``radius`` over all segments, it is at most 1 over one of radius/2 + 1 blocks of them.
    A grid has a cell per block and vector of counts in it; every fingerprint stands in its own cell and asks its own
    cell and those with one count higher (a lower one is the other's higher one). Rows that meet are held against the bound, then
    compared exactly, both in the join's condition: no pair that is not a link leaves it. All links are found; nothing is capped.
    With a column root, pairs of one root are left out and (u, v) are the roots; with a column name besides, a fingerprint may
    stand under several roots, its own rows are pairs too, and (u, v) are the names.
    """
    def masked(counts: Column, block: range) -> Column:
        return counts.bitwiseAND(_long(sum(3 << (2 * s) for s in block)))

    root = F.col("root") if "root" in fps.columns else F.col("fp").alias("root")
    name = "name" if "name" in fps.columns else "root"
    carried = list(dict.fromkeys(["root", name]))
    counted = fps.select("fp", _counts(F.col("fp")).alias("c"), root, *carried[1:])
    own, asks = [], []
    for k, block in enumerate(_blocks(radius)):
        cell = masked(F.col("c"), block)
        own.append(F.struct(F.lit(k).alias("block"), cell.alias("cell")))
        asks.append(F.struct(F.lit(k).alias("block"), cell.alias("cell"), F.lit(0).alias("step")))
        for s in block if radius else ():
            field = F.shiftrightunsigned("c", 2 * s).bitwiseAND(F.lit(3))
            higher = cell.bitwiseXOR(F.when(field == 0, _long(1 << (2 * s))).otherwise(_long(2 << (2 * s))))
            asks.append(F.when(field < 3, F.struct(F.lit(k).alias("block"), higher.alias("cell"), F.lit(1).alias("step"))))
    b = counted.select(F.col("fp").alias("v"), "c", *carried, F.inline(F.array(*own))).alias("b")
    a = counted.select(F.col("fp").alias("u"), "c", *carried, F.explode(F.array_compact(F.array(*asks))).alias("a")).select("u", "c", *carried, "a.*").alias("a")
    bound = F.bit_count(F.col("a.c").bitwiseXOR(F.col("b.c"))) <= radius
    near = F.bit_count(F.col("a.u").bitwiseXOR(F.col("b.v"))) <= radius
    once = (F.col("a.step") == 1) | (F.col("a.u") < F.col("b.v"))
    if name != "root":
        once |= (F.col("a.u") == F.col("b.v")) & (F.col(f"a.{name}") < F.col(f"b.{name}"))
    meet = (F.col("a.block") == F.col("b.block")) & (F.col("a.cell") == F.col("b.cell"))
    return a.join(b, meet & once & bound & near & (F.col("a.root") != F.col("b.root"))).select(F.col(f"a.{name}").alias("u"), F.col(f"b.{name}").alias("v"))


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (root among its columns) with the roots that ``links`` (u, v) between roots join made one."""
    found = components(links).select(F.col("node").alias("__old"), F.col("root").alias("__new"))
    return written(nodes.join(found, nodes["root"] == found["__old"], "left").withColumn("root", F.coalesce("__new", "root")).drop("__old", "__new"), "nodes")


def _named(each: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``each`` with component_id, the smallest ``first`` of its key's root in ``nodes`` (key, first, root)."""
    names = written(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "names")  # tables of their own leave the joins free to split hot keys
    known = written(nodes.join(names, "root").select(F.col(key).alias("__k"), "component_id"), "known")
    return each.join(known, F.col(key) == F.col("__k")).drop("__k")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """A row per document (doc_id, text): doc_id, fp, component_id, the smallest doc_id that links of at most ``radius`` bits reach.

    Equal fingerprints become one node before any join, so groups of copies cost one row; links are found between
    distinct fingerprints only and each keeps its exact distance check. Null and empty texts share fingerprint zero. Repeated rows stay;
    a null doc_id keeps its row and never names a component unless all of it is null; an empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    reach_workers(docs.sparkSession)
    each = written(fingerprints(docs, width), "fingerprints")
    nodes = written(each.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("root", F.col("fp")), "distinct")
    # wide links come last and only between what closer ones have left apart: a dense group is joined by few pairs, and no link is lost
    for step in [*range(3, radius, 2), radius]:
        nodes = _merged(nodes, near_pairs(nodes, step).distinct())
    return _named(each, nodes, "fp").select("doc_id", "fp", "component_id")


def wide_radius(similarity: float, bits: int = 64 * WIDE) -> int:
    """Differing bits up to which texts are candidates: 98 % of the pairs whose shingle sets overlap by just ``similarity`` are within it.

    Sets of overlap s are vectors at an angle of about acos(2s / (1 + s)), of which a bit tells by its share of a half turn.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + 2 * math.sqrt(bits * share * (1 - share)))


_WIDE_COLUMNS, _SAMPLE_COLUMNS = [f"w{k}" for k in range(WIDE)], [f"s{k}" for k in range(SAMPLES)]


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, WIDE + SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:WIDE], odd[WIDE:]


def _sketch(text: bytes, width: int, wide: np.ndarray, sampling: np.ndarray) -> list[int]:
    """The fingerprint of a text (:func:`_fingerprint`), the wide one of its distinct shingles, and for each sampling that of the three that it ranks first; zeros without words."""
    every = np.fromiter(_shingles(text, width), np.uint64)
    h = np.unique(every)
    if not len(h):
        return [0] * (1 + WIDE + SAMPLES)

    ones, least, ties = np.zeros(64 * WIDE, np.int64), np.full(WIDE, ~np.uint64(0)), np.zeros(WIDE, np.uint64)
    for at in range(0, len(h), 250):
        x = h[at : at + 250, None]
        y = (x ^ (x >> np.uint64(31))) * wide[None, :]
        y ^= y >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(y.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        first = y.argmin(axis=0)
        new = y[first, np.arange(WIDE)] < least
        least = np.where(new, y[first, np.arange(WIDE)], least)
        ties = np.where(new, y[first, (np.arange(WIDE) + 1) % WIDE], ties)
    # where just half of the shingles have a bit, each word of bits goes as another shingle has it, one that ranks first by the word before
    twice = 2 * ones - len(h) - 1 + np.unpackbits(np.roll(ties, 1).view(np.uint8), bitorder="little")
    out = [_majority(every[at : at + CHUNK] for at in range(0, len(every), CHUNK)), *np.packbits(twice >= 0, bitorder="little").view(np.uint64).tolist()]
    for factor in sampling:
        rank = (h ^ (h >> np.uint64(29))) * factor
        three = h[np.argpartition(rank, 2)[:3]] if len(h) > 3 else h
        a, b, c = three if len(three) == 3 else (three[0], three[0], three[-1])
        out.append(int((a & b) | (a & c) | (b & c)))
    return out


def _row_key() -> Column:
    """Names a text to be read again: a hash of id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, node, fp, w0.., s0..): fingerprints, wide ones and those of samples (:func:`_sketch`); node is a hash of the wide one, row names the text."""
    names = ["fp", *_WIDE_COLUMNS, *_SAMPLE_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, sampling = _factors()
        for batch in batches:
            rows = np.array([_sketch(t.as_py() or b"", width, wide, sampling) for t in batch.column(2).cast(pa.binary())], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(names)))], names=["doc_id", "row", *names])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), "text")
    found = texts.mapInArrow(run, f"doc_id long, row long, {', '.join(f'{x} long' for x in names)}")
    return found.select("doc_id", "row", F.xxhash64(*_WIDE_COLUMNS).alias("node"), *names)


def shingle_sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(node, shingles: sorted distinct hashes as bytes) of the texts that ``keys`` (node, row) name. Other texts are passed over in the scan by a bit map of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.fromiter(_shingles(t.as_py() or b"", width), np.uint64)).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["row", "shingles"])

    keys = keys.withColumnRenamed("row", "__row")
    wanted = maybe_repeated(docs.select("doc_id", "text"), _row_key(), key_map(keys.select(F.col("__row").alias("key"))), "__wanted").filter("__wanted")
    each = wanted.select(_row_key().alias("row"), "text").mapInArrow(run, "row long, shingles binary").groupBy("row").agg(F.first("shingles").alias("shingles"))
    return each.join(keys, F.col("row") == F.col("__row")).select("node", "shingles")


def overlapping(pairs: DataFrame, docs: DataFrame, keys: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) of nodes whose shingle sets overlap by ``similarity`` or more: hashes of 64 bits are counted one by one, nothing is estimated.

    Sets meet their pairs by two joins. A node with many pairs is dealt over as many copies of its set as it has ``CHECKED`` pairs, so its pairs do not meet in one task.
    """
    pairs = written(pairs.distinct(), "pairs")
    nodes = written(pairs.select(F.col("u").alias("__k")).unionByName(pairs.select(F.col("v").alias("__k"))).groupBy("__k").agg(F.ceil(F.count("*") / CHECKED).cast("int").alias("copies")), "checked")
    named = keys.join(nodes, F.col("node") == F.col("__k"))
    sets = written(shingle_sets(docs, named.select("node", "row"), width).join(nodes, F.col("node") == F.col("__k")).select("node", "shingles", "copies"), "sets")

    def with_set(df: DataFrame, side: str, other: str) -> DataFrame:
        held = sets.select(F.col("node").alias(f"__n{side}"), F.col("shingles").alias(f"set_{side}"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(f"__c{side}"))
        many = nodes.filter("copies > 1").select(F.col("__k").alias(f"__m{side}"), F.col("copies").alias(f"__of{side}"))
        dealt = df.join(many, F.col(side) == F.col(f"__m{side}"), "left").withColumn(f"__p{side}", F.pmod(F.xxhash64(other), F.coalesce(f"__of{side}", F.lit(1))).cast("int"))
        return dealt.join(held, (F.col(side) == F.col(f"__n{side}")) & (F.col(f"__p{side}") == F.col(f"__c{side}"))).select(*df.columns, f"set_{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"])

    return with_set(with_set(pairs, "v", "u"), "u", "v").select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def grid_candidates(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of all ``nodes`` (node, fp, root) of different roots whose fingerprints differ in at most ``radius`` bits.

    Nodes of one root and fingerprint ask the grid (:func:`near_pairs`) as one row, named by the smallest of them; in what is found each of them stands again, so none is left out.
    """
    groups = written(nodes.groupBy("fp", "root").agg(F.min("node").alias("name")), "groups")
    pairs = written(near_pairs(groups, radius).distinct(), "near")
    names = groups.select(F.col("fp").alias("__f"), F.col("root").alias("__r"), "name")
    held = written(nodes.join(names, (F.col("fp") == F.col("__f")) & (F.col("root") == F.col("__r"))).select("name", "node"), "held")
    for end in ("u", "v"):
        pairs = pairs.join(held.select(F.col("name").alias("__n"), F.col("node").alias("__k")), F.col(end) == F.col("__n")).withColumn(end, F.col("__k")).drop("__n", "__k")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row per document (doc_id, text): doc_id, component_id, the smallest doc_id that links reach; texts link if their shingle sets overlap by ``similarity`` or more.

    Candidates are all pairs whose 64-bit fingerprints differ in at most ``RADIUS`` bits: the grid of segment counts with its neighbouring cells, the Manhattan bound and the
    exact distance (:func:`grid_candidates`). Texts that overlap by just 0.8 differ in 10 of 64 bits, further than a grid can ask, so they are looked for besides: a text has a wide
    fingerprint, which tells candidates (:func:`wide_radius`), and fingerprints of a few samples of its shingles, which texts of that overlap share in one of
    ``SAMPLES`` with probability 0.98. Samples stand in the grid of segment counts at Manhattan distance 0; who meets in a cell is compared by wide
    fingerprints. A link of either kind is kept after an exact check of both shingle sets (:func:`overlapping`).

    Equal wide fingerprints are one node. All members of a cell of samples meet its ``LEADERS`` first. Between the components that are then left, all pairs within ``RADIUS`` bits
    are made; and in cells of samples that still hold several components, the members outside the largest meet all others of another one, each pair once.
    So pairs within a group of copies are not made, and of pairs within ``RADIUS`` bits or that share a cell none is left out. Null and empty texts are one group; odd rows as in :func:`near_duplicates`.
    """
    reach_workers(docs.sparkSession)
    radius = wide_radius(similarity)
    each = written(sketches(docs, width), "sketches")
    nodes = written(each.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.min_by("fp", "row").alias("fp"), *[F.min(c).alias(c) for c in (*_WIDE_COLUMNS, *_SAMPLE_COLUMNS)]), "distinct")
    texts, prints = nodes.select("node", "row"), nodes.select(F.col("node").alias("__k"), "fp")
    cells = nodes.select("node", F.inline(F.array(*[F.struct(F.lit(k).alias("sample"), _counts(F.col(c)).alias("cell")) for k, c in enumerate(_SAMPLE_COLUMNS)])))
    every = [_counts(F.col(c)).alias(f"cell{k}") for k, c in enumerate(_SAMPLE_COLUMNS)]
    keys, turn = ["sample", "cell"], [F.xxhash64("node", F.lit(k)) for k in range(LEADERS)]
    shared = written(cells.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(x).alias(f"turn{k}") for k, x in enumerate(turn)]).filter("n > 1").drop("n"), "cells")
    own = nodes.select(F.col("node").alias("__n"), *every, *_WIDE_COLUMNS)
    met = cells.join(shared, keys)
    leads = F.array_contains(F.array(*[x == F.col(f"turn{k}") for k, x in enumerate(turn)]), True).alias("leads")
    members = written(met.select("node", *keys, leads).join(own, F.col("node") == F.col("__n")).drop("__n"), "members")

    def near(a: str, b: str) -> Column:
        differing = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _WIDE_COLUMNS[1:]), F.bit_count(F.col(f"{a}.w0").bitwiseXOR(F.col(f"{b}.w0"))))
        return (F.col(f"{a}.sample") == F.col(f"{b}.sample")) & (F.col(f"{a}.cell") == F.col(f"{b}.cell")) & (differing <= radius)

    ends = [F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")]
    a, b = members.alias("a"), members.filter("leads").alias("b")
    links = overlapping(a.join(b, near("a", "b") & (F.col("a.node") != F.col("b.node"))).select(*ends), docs, texts, width, similarity)
    nodes = _merged(nodes.select("node", "first", F.col("node").alias("root")), links)
    rooted = members.drop("leads").join(nodes.select(F.col("node").alias("__n"), "root"), F.col("node") == F.col("__n")).drop("__n")
    held = rooted.groupBy(*keys, "root").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("main"))
    mixed = written(held.filter("roots > 1").drop("roots"), "mixed")
    rest = written(rooted.join(mixed, keys), "rest")
    a, b = rest.filter("root <> main").alias("a"), rest.alias("b")
    # a pair is made once: in the first of its common cells, all of which are here since its roots differ, and in one order
    first = F.lit(True)
    for k in range(SAMPLES):
        first &= (F.col("a.sample") <= k) | (F.col(f"a.cell{k}") != F.col(f"b.cell{k}"))
    once = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    grid = written(grid_candidates(nodes.join(prints, F.col("node") == F.col("__k")).select("node", "fp", "root")), "grid")
    sampled = written(a.join(b, near("a", "b") & once & first).select(*ends), "sampled")  # a stage of its own
    links = overlapping(grid.unionByName(sampled), docs, texts, width, similarity)
    for end in ("u", "v"):
        links = links.join(nodes.select(F.col("node").alias("__n"), F.col("root").alias("__r")), F.col(end) == F.col("__n")).withColumn(end, F.col("__r")).drop("__n", "__r")
    return _named(each.select("doc_id", "node"), _merged(nodes, links.distinct()), "node").select("doc_id", "component_id")


def op5_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles of ``documents`` and the components of links at three bits or fewer."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
