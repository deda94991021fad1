"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.shared import SPACE, WORD, read_table, written

#: Rows in one bucket of a running sum, about.
BUCKET_ROWS = 2000
#: Packets at most into which a copy is cut that the end of the budget interrupts.
PACKETS = 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns, so that rows that differ in any of them differ in it; of types that have no hash it takes their JSON."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*plain)


def running_base(sums: DataFrame, key: str, n: str, group: list[str] = (), width: int = 4096) -> DataFrame:
    """``sums`` (group, key long, n) with base, the sum of n over smaller keys of the group, in two levels: no task orders more than the keys of one range or the ranges."""
    each = sums.withColumn("__range", F.floor(F.col(key) / width))
    up = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranges = each.groupBy(*group, "__range").agg(F.sum(n).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(up(group, "__range")), zero)).drop("__n")
    out = each.join(ranges, [*group, "__range"]).withColumn("base", F.col("__base") + F.coalesce(F.sum(n).over(up([*group, "__range"], key)), zero))
    return out.drop("__range", "__base")


def source_targets(sizes: DataFrame, budget_share: float, weights: tuple[float, ...], max_repeats: float) -> DataFrame:
    """Targets of sources (skey, source, source_size): adds weight and target.

    Weights repeat over the sources in code point order, null last. Sources share ``budget_share`` of all sizes
    by weight; none gets more than ``max_repeats`` times its size, and the excess is shared again by weight.
    In closed form a target is ``least(cap, level x weight)``: with sources ordered by cap / weight, the level is the
    greatest of (budget - caps before) / (weights from here on). One row per source.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    each = sizes.withColumn("rank", F.row_number().over(by_name))
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") - 1) % len(weights) + 1))
    each = each.withColumn("cap", max_repeats * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before, used = F.coalesce(F.sum("cap").over(up), F.lit(0.0)), F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    each = each.withColumn("level", (budget_share * F.sum("source_size").over(whole) - before) / (F.sum("weight").over(whole) - used))
    return each.withColumn("target", F.least("cap", F.max("level").over(whole) * F.col("weight"))).select("skey", "source_size", "weight", "target")


def _hex_digits(rows: int) -> int:
    return max(1, min(12, math.ceil(math.log(max(1, rows) / BUCKET_ROWS, 16)))) if rows > BUCKET_ROWS else 1


def fair_mix(docs: DataFrame, budget_share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), max_repeats: int = 2, seed: str = "mix") -> DataFrame:
    """The mix as rows per document and epoch (doc_id, text, source): a weighted fair queue over the sources.

    Documents are shuffled within their source by a hash of id and text. Each copy gets a virtual finish time: the source's words
    up to its end divided by the source's target. Copies of all sources are range-sorted by it and taken until the total budget,
    ``budget_share`` of all words, is used up. A copy that is in service at virtual time 1, when the budget ends in theory, counts as up to ``PACKETS`` packets with
    finish times of their own, so a source misses its target by a packet or so and not by a long document. Repeats come as epochs 0, 1, ...

    Returns doc_id, tie (a hash of the whole row), twin (numbers rows that are equal in all columns), skey, source_size, target, size, epoch, words (that the mix takes of the copy) and
    position (words of the mix before it; null if it takes none). The first copy of every document is there.
    Equal rows are one row with a count until their places are drawn. Running sums go through buckets of about ``BUCKET_ROWS`` rows by hash and by virtual time, so neither a hot source nor
    null or repeated ids meet in one task. Null text has no words, a null source is one source, repeated rows are separate documents, an empty table gives no rows.
    """
    rows = docs.count()
    digits = _hex_digits(rows)
    draw = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    each = docs.select("doc_id", "source", word_count().alias("size"), row_key(docs).alias("tie"), draw.alias("draw")).groupBy("doc_id", "source", "size", "tie", "draw").agg(F.count("*").alias("twins"))
    narrow = written(
        each.withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
        .withColumn("bucket", F.conv(F.substring("draw", 1, digits), 16, 10).cast("long")),
        "sizes",
    )
    sums = written(narrow.groupBy("skey", "bucket").agg(F.sum(F.col("size") * F.col("twins")).alias("n"), F.first("source").alias("source")), "sums")
    sizes = sums.groupBy("skey").agg(F.sum("n").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes, budget_share, weights, float(max_repeats))
    bases = running_base(sums.drop("source"), "bucket", "n", ["skey"]).drop("n").join(targets, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("draw", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    queued = narrow.join(bases, ["skey", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("twins")).over(inside), F.lit(0)))
    single = queued.withColumn("twin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("twins") - 1))).withColumn("start", F.col("start") + F.col("twin") * F.col("size"))
    known = ["doc_id", "tie", "twin", "skey", "draw", "source_size", "target", "size"]
    epochs = F.array(*[F.struct(F.lit(k).alias("epoch"), (F.col("start") + k * F.col("source_size")).alias("start")) for k in range(max_repeats)])
    copies = single.select(*known, F.inline(epochs))
    # whole copies are one packet; the one that virtual time 1 cuts is several
    cut = (F.col("start") < F.col("target")) & (F.col("start") + F.col("size") > F.col("target"))
    packet = F.when(cut, F.ceil(F.col("size") / PACKETS)).otherwise(F.greatest("size", F.lit(1)))
    packets = copies.withColumn("packet", packet).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / F.col("packet")), F.lit(1)) - 1)))
    begun = F.col("part") * F.col("packet")
    words = F.least(F.col("packet"), F.col("size") - begun)
    packets = packets.withColumn("words", words).withColumn("virtual_finish", F.when((F.col("target") > 0) & (F.col("words") > 0), (F.col("start") + begun + F.col("words")) / F.col("target")))
    packets = packets.filter("epoch = 0 OR words > 0")
    slots = max(1, rows // BUCKET_ROWS)
    slot = F.when(F.col("virtual_finish").isNotNull(), F.floor(F.col("virtual_finish") * slots)).otherwise(-1 - F.pmod(F.xxhash64("draw", "twin"), F.lit(slots)))
    packets = written(packets.select(*known, "epoch", "part", "words", "virtual_finish", slot.cast("long").alias("slot")), "packets")
    total = narrow.agg(F.sum(F.col("size") * F.col("twins"))).first()[0] or 0
    budget = math.floor(budget_share * total)
    bases = running_base(packets.groupBy("slot").agg(F.sum("words").alias("n")), "slot", "n").drop("n")
    ordered = Window.partitionBy("slot").orderBy("virtual_finish", "skey", "draw", "doc_id", "tie", "twin", "epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    at = packets.join(bases, "slot").withColumn("position", F.col("base") + F.coalesce(F.sum("words").over(ordered), F.lit(0)))
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), budget - F.col("position")))
    taken = at.withColumn("words", left).withColumn("position", F.when(F.col("words") > 0, F.col("position")))
    of = ["doc_id", "tie", "twin", "skey", "source_size", "target", "size", "epoch"]
    parts = taken.filter("part > 0 OR words < size").groupBy(*of).agg(F.sum("words").alias("words"), F.min("position").alias("position"))
    return taken.filter("part = 0 AND words = size").select(*of, "words", "position").unionByName(parts).filter("epoch = 0 OR words > 0")


def document_shares(mix: DataFrame) -> DataFrame:
    """A row per document of :func:`fair_mix`: doc_id, size, source_size, target, taken, position of its first copy (null: not taken)."""
    key = ["doc_id", "tie", "twin"]
    return mix.groupBy(*key, "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min("position").alias("position")).drop("tie", "twin")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy, globally sorted by position; a copy that the budget cuts has its first words only.

    A column may have any name that does not begin with two underscores; null ids, repeated rows and empty tables are as in :func:`fair_mix`.
    """
    served = written(fair_mix(docs, **how).filter("words > 0").select(F.col("doc_id").alias("__doc"), F.col("tie").alias("__t"), F.struct("position", "words", "size").alias("__copy")), "served")
    rows = docs.withColumn("__tie", row_key(docs)).dropDuplicates(["doc_id", "__tie"])
    each = rows.join(served, rows["doc_id"].eqNullSafe(served["__doc"]) & (rows["__tie"] == served["__t"])).select(*docs.columns, "__copy")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"{SPACE}*{WORD}"), F.lit(0)), F.lit(1), F.col("__copy.words").cast("int")), "")
    each = each.withColumn("text", F.when(F.col("__copy.words") < F.col("__copy.size"), cut).otherwise(F.col("text")))
    return each.withColumn("__at", F.col("__copy.position")).drop("__copy").repartitionByRange("__at").sortWithinPartitions("__at").drop("__at")


def op4_fair_queue_mix(spark, sf_dir: str) -> DataFrame:
    """``documents`` mixed at weights 3, 1, 2 to 150 % of all words, no document more than twice."""
    return document_shares(fair_mix(read_table(spark, sf_dir, "documents")))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR) || ':mix:' || md5(coalesce(text, ''))) AS draw
  FROM documents),
s AS (SELECT skey, source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
c AS (SELECT *, 2.0 * source_size AS cap, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight FROM w),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0.0)) AS level
  FROM c WINDOW up AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT skey, CAST(source_size AS BIGINT) AS source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
q AS (
  SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY skey ORDER BY draw, doc_id) AS BIGINT) - size AS start
  FROM d JOIN t USING (skey)),
k AS (SELECT q.*, epoch, start + epoch * source_size AS begun FROM q CROSS JOIN (VALUES (0), (1)) AS e(epoch) WHERE size > 0),
z AS (SELECT *, CASE WHEN begun < target AND begun + size > target THEN CAST(ceil(size / 1024) AS BIGINT) ELSE size END AS packet FROM k),
x AS (SELECT *, unnest(range(CAST(ceil(size / packet) AS BIGINT))) AS part FROM z),
v AS (SELECT *, least(packet, size - part * packet) AS words, CAST(begun + part * packet + least(packet, size - part * packet) AS DOUBLE) / target AS vf FROM x),
p AS (SELECT *, CAST(sum(words) OVER (ORDER BY vf, skey, draw, doc_id, epoch, part ROWS UNBOUNDED PRECEDING) AS BIGINT) - words AS position FROM v),
c2 AS (SELECT *, greatest(0, least(words, CAST(floor(1.5 * (SELECT sum(size) FROM d)) AS BIGINT) - position)) AS taken FROM p),
g AS (SELECT doc_id, CAST(sum(taken) AS BIGINT) AS taken, min(position) FILTER (WHERE taken > 0) AS position FROM c2 GROUP BY 1)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0) AS taken, g.position
FROM q LEFT JOIN g USING (doc_id)
"""
