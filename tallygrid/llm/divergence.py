"""Source divergence audit: how far the term shares of sources lie apart, by Gustavson's row accumulation over a term-major index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.shared import read_table, written

#: A term is kept if so many documents of its language have it.
MIN_DOCS = 30
#: Smoothing: so many occurrences are added to each kept term; shares are whole numbers of 1 / SCALE.
SMOOTH, SCALE = 5, 1_000_000_000
#: Terms of a group that the audit lists.
TOP_TERMS = 50
#: Entries that a task counts before it hands them on.
HELD = 500_000
#: Postings in one block of the index, about; a block has at least as many as its lang has pairs of groups, so that sums of blocks stay small beside postings, up to LARGE_BLOCK.
BLOCK, LARGE_BLOCK = 25_000, 2_000_000
#: Up to so many groups are broadcast (about 50 MB).
GROUP_ROWS = 300_000
#: Bytes of a text that are cut into terms at a time.
_PIECE = 1 << 20
#: Letters of ASCII in lower case and all bytes of other code points; any other byte ends a term.
_TERM_BYTES = bytes((b | 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def cut_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces of bounded size."""
    rest = b""
    for at in range(0, len(text), _PIECE):
        piece = rest + text[at : at + _PIECE].translate(_TERM_BYTES)
        found = piece.split(b" ")
        rest = found.pop() if at + _PIECE < len(text) else b""
        yield [x for x in found if x]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of each term in each group; counted in the tasks before the one shuffle, which is by lang and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        new = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in groups.items():
                if d:
                    names = list(d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), pa.array([n[x] for x in names], pa.int64()), pa.array([d[x] for x in names], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                before = len(d)
                for terms in cut_terms(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                d.update(own)
                new += len(d) - before
                if new >= HELD:
                    yield from rows()
                    new = 0
        yield from rows()

    none = F.lit("")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), none).alias(c) for c in ("lang", "source", "text")])
    each = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return each.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH v)) in exact decimals."""
    wide = lambda x, p: x.cast(f"decimal({p},0)")
    return F.call_function("div", wide(n + SMOOTH, 20) * wide(F.lit(SCALE), 10), wide(total + SMOOTH * v, 20)) + 1


def accumulate(block: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, peer, value) of what a block of the index adds to pairs of groups: postings (term, group, p, z), in which z is a group's share of a term that it lacks.

    The postings are laid out term-major and group-major. Each group's row scatters its terms through the term-major
    index into a dense accumulator with a place per group. A shared term adds \\|p - q\\| in place of what the baselines
    take for it, \\|p - z'\\| + \\|z - q\\| - \\|z - z'\\|.
    """
    term, group, p, z = (np.concatenate(x) for x in zip(*block))
    _, term = np.unique(term, return_inverse=True)
    names, group = np.unique(group, return_inverse=True)
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(term.max() + 2))
    peer, q, zq = group[by_term], p[by_term], z[by_term]
    by_group = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[by_group], np.arange(len(names) + 1))
    rows, peers, values = [], [], []
    for i in range(len(names)):
        own = by_group[bounds[i] : bounds[i + 1]]
        dense, touched = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        for some in np.array_split(own, max(1, len(own) * len(names) // (4 * LARGE_BLOCK))):  # a bounded number of products at a time
            first, many = starts[term[some]], starts[term[some] + 1] - starts[term[some]]
            at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            pi, zi = np.repeat(p[some], many), z[own[0]]
            np.add.at(dense, peer[at], np.abs(pi - q[at]) - np.abs(pi - zq[at]) - np.abs(zi - q[at]) + np.abs(zi - zq[at]))
            touched[peer[at]] = True
        touched[i] = False
        hit = np.flatnonzero(touched)
        rows.append(np.full(len(hit), names[i]))
        peers.append(names[hit])
        values.append(dense[hit])
    return np.concatenate(rows), np.concatenate(peers), np.concatenate(values)


def shared_terms(postings: DataFrame) -> DataFrame:
    """(row, peer, value): sums of :func:`accumulate` over the postings (block, term, gid, p, z), in which a term is in one block only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        names: dict[str, int] = {}

        def done() -> pa.RecordBatch:
            row, peer, value = accumulate(held)
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(peer), pa.array(value)], names=["row", "peer", "value"])

        last = None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and blocks[a] != last:
                    yield done()
                last = blocks[a]
                own = batch.slice(a, b - a)
                ids = np.array([names.setdefault(x, len(names)) for x in own.column(1).to_pylist()], np.int64)
                held.append((ids, *(own.column(k).to_numpy() for k in (2, 3, 4))))
        if held:
            yield done()

    dealt = postings.repartition("block").sortWithinPartitions("block").select("block", "term", "gid", "p", "z")
    return dealt.mapInArrow(run, "row long, peer long, value long").groupBy("row", "peer").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text).

    Terms are runs of letters (ASCII, A-Z in lower case, and all other code points beyond ASCII); each lang keeps those in at least ``min_docs`` of its documents. A group is a (lang, source) that occurs.
    Part ``pair``: the sum of the differences between the group's and another source's shares over all kept terms. Part ``term``: the ``top`` terms whose share is the most above the lang's.

    Terms that both groups have come from :func:`shared_terms`, so no pairs of postings are emitted. The rest needs no terms: a group's shares depend on counts alone, so
    the distance of its terms from another group's baseline z is a running sum over its (count, number of terms), a table of at most sqrt(2 x occurrences) rows a group, met at z.
    Terms that neither has add \\|z - z'\\| each.

    Null text, lang and source are ''. Every row counts as a document, repeated ones too; other columns are ignored, an empty table gives no rows. A lang without kept terms has pairs of value 0 and no
    terms. The table of groups is broadcast up to ``GROUP_ROWS`` rows.
    """
    none = F.lit("")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), none).alias(c) for c in ("lang", "source")]).distinct()
    index = term_counts(docs).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("postings"), F.sum("docs").alias("docs"), F.sum("n").alias("all"))  # a posting per source at most
    index = written(index.filter(F.col("docs") >= min_docs).drop("docs"), "terms")
    langs = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    each = index.select("lang", "term", "all", F.inline("postings"))
    held = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    zero = F.lit(0).cast("long")
    named = groups.join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "has", "v", "lang_n"])
    named = named.withColumn("gid", F.xxhash64("lang", "source")).withColumn("z", F.when(F.col("v") > 0, _share(zero, F.col("total"), F.col("v"))).otherwise(zero))
    named = written(named, "groups")
    facts = named.select("lang", "source", "gid", "total", "v", "lang_n", "z")
    of_lang = Window.partitionBy("lang")
    size = F.least(F.lit(max(BLOCK, LARGE_BLOCK)), F.greatest(F.lit(BLOCK), F.pow(F.count("*").over(of_lang), 2)))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("has").over(of_lang) / size))
    facts = facts.join(named.select("gid", blocks.alias("blocks")), "gid")
    known = each.join(F.broadcast(facts) if named.count() <= GROUP_ROWS else facts, ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("v"))
    known = written(known.select("lang", "source", "term", "n", "all", "gid", "z", "v", "lang_n", "blocks", p.alias("p")), "postings")

    block = F.xxhash64("lang", F.pmod(F.xxhash64("term"), F.col("blocks")))
    shared = shared_terms(known.select(block.alias("block"), "term", "gid", "p", "z"))

    # how far a group's own terms lie from the baselines of the lang's other groups
    points = known.groupBy("lang", "gid", "p").agg(F.count("*").alias("many")).select("lang", "gid", "p", "many", F.lit(None).cast("long").alias("peer"))
    base = named.select("lang", "source", "gid", "z", "has", "v")
    other = base.select("lang", F.col("source").alias("item"), F.col("gid").alias("peer"), F.col("z").alias("peer_z"), F.col("has").alias("peer_has"))
    pairs = base.join(other, "lang").filter(F.col("gid") != F.col("peer"))
    asked = pairs.select("lang", "gid", F.col("peer_z").alias("p"), F.lit(0).cast("long").alias("many"), "peer")
    wide = lambda x: x.cast("decimal(38,0)")
    up = Window.partitionBy("gid").orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("gid")
    weight = wide(F.col("many")) * F.col("p").cast("decimal(19,0)")
    below, lower = F.sum("many").over(up), F.sum(weight).over(up)
    far = F.col("p") * below - lower + (F.sum(weight).over(whole) - lower) - F.col("p") * (F.sum("many").over(whole) - below)
    away = points.unionByName(asked).withColumn("away", far.cast("long")).filter("peer IS NOT NULL").select("gid", "peer", "away")
    back = away.select(F.col("gid").alias("peer"), F.col("peer").alias("gid"), F.col("away").alias("back"))
    both = pairs.join(away, ["gid", "peer"]).join(back, ["gid", "peer"]).join(shared.withColumnRenamed("row", "gid"), ["gid", "peer"], "left")
    rest = (F.col("v") - F.col("has") - F.col("peer_has")) * F.abs(F.col("z") - F.col("peer_z"))
    apart = both.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("away") + F.col("back") + rest + F.coalesce("value", zero)).alias("value"))

    over = F.col("p") - _share(F.col("all"), F.col("lang_n"), F.col("v"))
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).filter("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(ranked)
    return apart.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergence between the sources of each lang in ``documents``, and the terms that set a source apart."""
    return divergence(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, source, k, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_count FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(term) AS v, coalesce(sum(lang_count), 0) AS n FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT g.lang, g.source, term, count(x.k) AS count FROM g JOIN kept USING (lang) LEFT JOIN w x USING (lang, source, term) GROUP BY ALL),
p AS (SELECT c.*, 1 + (1000000000::HUGEINT * (count + 5)) // (sum(count) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN l USING (lang)),
pair AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
         FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source
         LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) s
           ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value
         FROM p JOIN (SELECT lang, term, 1 + (1000000000::HUGEINT * (lang_count + 5)) // (n + 5 * v) AS q FROM kept JOIN l USING (lang)) q USING (lang, term)
         WHERE p.count > 0 AND p.p > q.q)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 50
"""
