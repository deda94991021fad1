"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.shared import read_table, text_key, written

#: Documents in one bucket of neighbours, about; of more than RING times as many documents a bucket has more, so that a row per bucket may be broadcast (24 MB).
BUCKET_ROWS, RING = 100, 1_000_000
#: Approximate quantiles of the ids, between which buckets are dealt evenly.
QUANTILES = 1024
#: Groups of near copies with so large a share of all documents (and so many) count as one document each; there are at most 1 / HOT_SHARE.
HOT_SHARE, HOT_ROWS = 0.01, 20
#: Other orders of hashes, in which minima are independent.
TURNS = (0x5BD1E9955BD1E995, 0x27D4EB2F165667C5)
#: A lexicon of so many rows at most is broadcast (about 40 MB).
LEXICON_ROWS = 1_000_000
#: The band: terms in at least MIN_SHARE and at most MAX_SHARE of all documents.
MIN_SHARE, MAX_SHARE = 0.0005, 0.2
#: A random subset k holds a term with probability 1 / 2^e, e = EXPONENTS[k]. Large subsets tell copies with few changes from others, small ones still agree when half of a text is new.
EXPONENTS = (5,) * 8 + (6,) * 10 + (7,) * 16 + (8,) * 16 + (9,) * 12
SUBSETS = len(EXPONENTS)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def _turned(by: int):
    return lambda x: x.bitwiseXOR(F.lit(by))


def _alike(words: Column) -> Column:
    """A key that near copies mostly share and other documents hardly ever: three independent minima over the terms."""
    def minima(h: Column) -> Column:
        return F.xxhash64(F.array_min(h), *[F.array_min(F.transform(h, _turned(c))) for c in TURNS])

    return F.get(F.transform(F.array(F.transform(words, lambda t: F.xxhash64(t))), minima), F.lit(0))  # terms are cut and hashed once


def hot_groups(docs: DataFrame) -> dict[int, int]:
    """Keys and sizes of the groups of copies and near copies that hold at least ``HOT_SHARE`` of all documents: 1 / HOT_SHARE at most."""
    n = docs.count()
    keys = docs.select(_alike(terms(_text())).alias("k")).groupBy("k").count()
    return {r["k"]: r["count"] for r in keys.filter(F.col("count") >= max(HOT_ROWS, HOT_SHARE * n)).collect()} if n else {}


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term, subset): the terms whose inverse document frequency is within the band, in each random subset that has them.

    ln(1 / max_share) <= ln(N / df) <= ln(1 / min_share), counted over all documents. Against the upper bound of df each of the :func:`hot_groups` counts as one document, against the
    lower one as what it holds, so that the terms of a hot text are neither too common nor too rare. The size is bounded whatever the corpus: at most (mean distinct terms per document) / min_share terms reach that frequency, and a term is in 0.6 subsets on average.
    """
    hot, n = hot_groups(docs), docs.count()
    raw, weighed_n = F.count("*"), n
    if hot:  # a group weighs as much as one document, else a text that a third of all documents copy would push its own terms out of the band
        weighed_n += len(hot) - sum(hot.values())
        cut = docs.select(F.explode(F.array(terms(_text()))).alias("t"))  # terms are cut once
        one = 1 << 20  # sums of doubles depend on their order: count in parts of 2^-20
        own = F.try_element_at(F.create_map(*[F.lit(x) for k, c in sorted(hot.items()) for x in (k, round(one / c))]), _alike(F.col("t")))
        weighed = cut.select(F.coalesce(own, F.lit(one)).cast("long").alias("part"), "t")  # a select of its own: beside explode it would be worked out for every term
        each, df = weighed.select("part", F.explode("t").alias("term")), F.sum("part") / one
    else:
        each, df = docs.select(F.explode(terms(_text())).alias("term")), raw
    found = each.groupBy("term").agg(df.alias("df"), raw.alias("raw"))
    # the lower bound holds for plain counts: weighed as one document, a hot text would lose its own terms there
    kept = found.filter((F.col("raw") >= min_share * n) & (F.col("df") <= max(max_share * weighed_n, 1)))
    drawn = [F.when(F.xxhash64(F.col("term"), F.lit(f"subset {k}")).bitwiseAND(F.lit((1 << e) - 1)) == 0, F.lit(k)) for k, e in enumerate(EXPONENTS)]
    # tied to df, so that no filter on the subsets moves below the aggregation and hashes each occurrence
    return kept.select("term", F.explode(F.when(F.col("df") > 0, F.array_compact(F.array(*drawn)))).alias("subset"))


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that have terms in either document; parts are "subset=hash"."""
    def names(parts: Column) -> Column:
        return F.transform(parts, lambda x: F.split_part(x, F.lit("="), F.lit(1)))

    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(names(a), names(b)))


def _share(x: Column, lo: Column, hi: Column, parts: Column) -> Column:
    """Which of ``parts`` even ranges of [lo, hi) holds x."""
    at = (x.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double"))
    return F.least(F.floor(at * parts), parts - 1).cast("long")


def _buckets(docs: DataFrame) -> Column:
    """The bucket of a document (doc_id, tie): an order-preserving number.

    Approximate quantiles cut the ids into even ranges, and each range is cut evenly again until a bucket has about ``BUCKET_ROWS`` rows. An id
    (or null) that fills a whole range is cut by tie, a hash, so however many rows have it they are spread.
    """
    counts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    n, rows = counts["n"], max(BUCKET_ROWS, counts["n"] // RING)
    cuts = max(1, min(QUANTILES, counts["ids"] // rows))
    found = docs.agg(F.percentile_approx("doc_id", [k / cuts for k in range(1, cuts)], 20 * QUANTILES)).first()[0] if cuts > 1 else []
    per_null = max(1, (n - counts["ids"]) // rows)
    tie = lambda parts: _share(F.col("tie"), F.lit(-(1 << 63)), F.lit(1 << 62).cast("double") * 2, F.lit(parts))
    if not counts["ids"]:
        return tie(per_null)
    bounds = sorted([counts["lo"], *found])
    ranges, first = [], per_null  # (from, to or null if it is one id, parts, bucket of the first part)
    for lo in sorted(set(bounds)):
        times = bounds.count(lo)
        held = counts["ids"] / cuts
        if times > 1:
            parts = max(1, int(held * times / rows))
            ranges.append((lo, None, parts, first))
            first += parts
            lo += 1
        later = next((b for b in bounds if b > lo), counts["hi"] + 1)
        if later > lo:
            parts = max(1, int(held / rows))
            ranges.append((lo, later, parts, first))
            first += parts
    starts = F.array(*[F.lit(r[0]).cast("long") for r in ranges])
    width = max(1, int(len(ranges) ** 0.5))
    heads = F.array(*[F.lit(ranges[k][0]).cast("long") for k in range(0, len(ranges), width)])
    i = (F.size(F.filter(heads, lambda b: b <= F.col("doc_id"))) - 1) * width  # two short scans in place of one long one
    at = i + F.size(F.filter(F.slice(starts, i + 1, F.lit(width)), lambda b: b <= F.col("doc_id"))) - 1
    table = F.from_json(F.lit(str([[0 if x is None else x for x in (*r, r[1] is None)] for r in ranges]).replace("True", "1").replace("False", "0")), "array<array<bigint>>")
    own = F.get(table, at)
    inside = F.when(F.get(own, F.lit(4)) == 1, _share(F.col("tie"), F.lit(-(1 << 63)), F.lit(1 << 62).cast("double") * 2, F.get(own, F.lit(2)))).otherwise(_share(F.col("doc_id"), F.get(own, F.lit(0)), F.get(own, F.lit(1)), F.get(own, F.lit(2))))
    return F.when(F.col("doc_id").isNull(), tie(per_null)).otherwise(F.get(own, F.lit(3)) + inside)


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """Documents in buckets that follow (doc_id, tie), each bucket led by a ghost of the document just below it.

    Columns: bucket, ghost, doc_id, tie, text. The first bucket's ghost is the largest document; doc_id null comes below all others.
    """
    rows = docs.select("doc_id", _text().alias("text")).withColumn("tie", text_key())
    own = rows.withColumn("own", _buckets(rows.select("doc_id", "tie")))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "tie")
    ends = own.groupBy("own").agg(F.max(order).alias("last"))
    ring = ends.select("own", "last", F.coalesce(F.lead("own").over(Window.orderBy("own")), F.min("own").over(Window.partitionBy())).alias("next"))
    # a row per bucket, about RING at most: small enough to broadcast
    led = own.join(F.broadcast(ring), "own").withColumn("to", F.explode(F.array_compact(F.array(
        F.struct(F.col("own").alias("bucket"), F.lit(0).alias("ghost")),
        F.when(order == F.col("last"), F.struct(F.col("next").alias("bucket"), F.lit(1).alias("ghost"))),
    ))))
    return led.select("to.bucket", "to.ghost", "doc_id", "tie", "text")


def fingerprint_edits(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of their edited texts, and how alike they are.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many of the next document
    in descending doc_id order (after the last: the first). Returns doc_id, n_chars, text, edited, fingerprint,
    edited_fingerprint, near_edited, near_next. Null text is empty. Documents that repeat a doc_id are ordered by
    a hash of their text; a null doc_id is the smallest; a single document is its own next one. An empty table gives no rows; other columns, whatever their names, are ignored.

    One shuffle carries texts, by bucket of neighbours; terms meet the broadcast lexicon and are gathered again in that
    same partitioning. A second, of term counts, makes the lexicon.
    """
    docs = docs.select("doc_id", "text")
    words = written(lexicon(docs, min_share, max_share), "lexicon")
    order = Window.partitionBy("bucket").orderBy(F.col("ghost").desc(), F.col("doc_id").asc_nulls_first(), "tie")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = _with_neighbours(docs).withColumn("rn", F.row_number().over(order)).withColumn("next", F.lag("text").over(order))
    edited = F.when(F.col("ghost") == 0, F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half)))
    rows = rows.withColumn("edited", edited).drop("next")
    about = F.struct("ghost", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("t"), F.xxhash64("edited").alias("e"))
    kind = "struct<ghost:int,doc_id:bigint,n_chars:bigint,edited_sha256:string,t:bigint,e:bigint>"

    def tagged(text: Column, of: int) -> Column:
        return F.transform(terms(text), lambda t: F.struct(t.alias("term"), F.lit(of).alias("of"), F.lit(None).cast(kind).alias("about")))

    # one row of each document says what it is, the others are narrow: a term of the text (1) or of the edited text (2)
    own = F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("of"), about.cast(kind).alias("about")))
    each = rows.select("bucket", "rn", F.inline(F.concat(own, tagged(F.col("text"), 1), F.coalesce(tagged(F.col("edited"), 2), F.slice(own, 1, 0)))))
    known = words.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).alias("subset")))
    hashed = each.join(F.broadcast(known) if words.count() <= LEXICON_ROWS else known, "term").groupBy("bucket", "rn", "of", "subset").agg(
        F.xxhash64(F.sort_array(F.collect_list("term"))).alias("h"), F.max("about").alias("about"))
    part = F.concat(F.lpad(F.col("subset").cast("string"), 2, "0"), F.lit("="), F.substring(_hex(F.col("h")), 1, 8))
    gathered = hashed.groupBy("bucket", "rn").agg(
        F.max("about").alias("x"), *[F.sort_array(F.collect_list(F.when(F.col("of") == k, part))).alias(c) for k, c in ((1, "a"), (2, "b"))])

    def known_by(parts: str, whole: str) -> Column:  # a text without terms in any subset is known by its whole hash
        return F.when(F.size(parts) > 0, F.col(parts)).otherwise(F.array(F.concat(F.lit("*="), _hex(F.col(whole))))).alias(parts)

    line = Window.partitionBy("bucket").orderBy("rn")
    done = gathered.select("bucket", "rn", "x.*", "a", "b").select("bucket", "rn", "ghost", "doc_id", "n_chars", "edited_sha256", known_by("a", "t"), known_by("b", "e"))
    done = done.withColumn("c", F.lag("a").over(line)).filter("ghost = 0")
    return done.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("a", ".").alias("fingerprint"), F.array_join("b", ".").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


def op3_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts."""
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))
