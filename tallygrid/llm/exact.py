"""Exact dedup by progressive refinement: lengths, then hashes of beginnings, then hashes of whole texts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.llm.shared import read_table, written

#: Code points of a text's beginning.
PREFIX = 256
#: Bits of a map of repeated keys: 2^20 words of 64 bits at most, whatever the corpus (about 40 MB as a broadcast table).
MAP_BITS = 26
#: A group with one of so many parts of all rows is hot; there are at most as many.
HOT_PARTS = 500
_OUT = ("keep_id", "group_size", "kept")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _cell(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << MAP_BITS) - 1))


def key_map(keys: DataFrame) -> DataFrame:
    """(word, bits): a bit map of keys (key long); a key's bit is its last ``MAP_BITS`` bits. Its size is bounded, so it may be broadcast."""
    cells = keys.select(_cell(F.col("key")).alias("cell"))
    return cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS int))")).alias("bits"))


def repeated_map(keys: DataFrame) -> DataFrame:
    """The :func:`key_map` of the keys (key long, n) that are found more than once.

    Keys that share a bit with a repeated one count as repeated: that costs a hash more and changes no result.
    """
    return key_map(keys.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"))


def maybe_repeated(rows: DataFrame, key: Column, found: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column``: false if ``key`` is surely not in the map ``found``."""
    bits = F.broadcast(found.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    both = rows.withColumn("__cell", _cell(key)).join(bits, F.shiftright("__cell", 6) == F.col("__word"), "left")
    return both.withColumn(column, F.coalesce(F.getbit("__bits", F.col("__cell").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))).drop("__cell", "__word", "__bits")


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Every row of documents (doc_id, text, others) without its text, with keep_id, group_size and kept of its group of equal texts.

    Lengths come first; rows whose length is found again are told apart by a hash of their first ``prefix`` code points, and only the rows that share length and hash are read whole:
    a hash of 256 bits of the whole text, with the length, decides. The first pass leaves 16 bytes a row; what it finds is handed on as bit maps of bounded size, so no text
    is shuffled. Groups are map-side aggregates; those with 1 / ``HOT_PARTS`` of all rows or more (``HOT_PARTS`` at most) reach their rows by broadcast, the others by a join.

    The row with the largest doc_id stays. Null text equals empty text. A null doc_id is smaller than any other; of rows that repeat both doc_id and text one stays, the others have kept = false
    and the same keep_id. Other columns stay, whatever their names (two leading underscores excepted); those called keep_id, group_size or kept are replaced. An empty table gives no rows.
    """
    n_bytes, start = F.octet_length(_text()).cast("long"), F.xxhash64(F.substring(_text(), 1, prefix))
    narrow = written(docs.select(n_bytes.alias("n_bytes"), start.alias("start")), "lengths")
    lengths = written(repeated_map(narrow.groupBy(F.xxhash64("n_bytes").alias("key")).agg(F.count("*").alias("n"))), "same-length")
    pair = F.xxhash64("n_bytes", "start")
    left = maybe_repeated(narrow, F.xxhash64("n_bytes"), lengths, "__again").filter("__again")
    starts = written(repeated_map(left.groupBy(pair.alias("key")).agg(F.count("*").alias("n"))), "same-start")

    names = [c for c in docs.columns if c != "text" and c not in _OUT]
    keyed = maybe_repeated(docs.withColumn("__bytes", n_bytes), F.xxhash64("__bytes", start), starts, "__again")
    whole = F.when(F.col("__again"), F.unhex(F.sha2(_text(), 256)))
    rows = written(keyed.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias("__row"), "__bytes", whole.alias("__whole")), "hashed")

    shared = rows.filter("__whole IS NOT NULL")
    groups = shared.groupBy("__bytes", "__whole").agg(F.count("*").alias("__size"), F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.col("__row").alias("row"))).alias("__keep"))
    groups = written(groups.filter("__size > 1").select(F.col("__bytes").alias("__b"), F.col("__whole").alias("__w"), "__size", F.col("__keep.doc_id").alias("__id"), F.col("__keep.row").alias("__kept")), "groups")
    is_hot = F.col("__size") >= max(2, rows.count() / HOT_PARTS)
    same = (F.col("__bytes") == F.col("__b")) & (F.col("__whole") == F.col("__w"))
    marked = shared.join(F.broadcast(groups.filter(is_hot)), same, "left")
    others = marked.filter("__size IS NULL").select(*rows.columns).join(groups.filter(~is_hot), same, "left")
    alone = rows.filter("__whole IS NULL").join(groups.limit(0), same, "left")

    def told(df: DataFrame) -> DataFrame:
        one = F.col("__size").isNull()
        return df.select(
            *[F.col(f"`{c}`") for c in names], F.when(one, F.col("doc_id")).otherwise(F.col("__id")).alias("keep_id"), F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
            (one | (F.col("__row") == F.col("__kept"))).alias("kept"),
        )

    return told(marked.filter("__size IS NOT NULL")).unionByName(told(others)).unionByName(told(alone))


def op11_exact_groups(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts in ``documents``; the row with the largest doc_id stays."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_groups(docs.withColumn("text_sha256", F.sha2(_text(), 256)))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT doc_id, text, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
             row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) AS nth FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(text) AS text_sha256 FROM g
"""
