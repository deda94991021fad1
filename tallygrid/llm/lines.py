"""Line dedup: repeated lines are found by hash and removed through per-document keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.llm.shared import read_table, written

MIN_CHARS, MIN_DOCS = 20, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _row_key() -> Column:
    return F.xxhash64(_text())


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keep bitmaps of documents (doc_id, text) that lose lines: doc_id, row_key, keep (array of {word, bits}).

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents stay only in the largest doc_id that holds them. Bit i of
    word w tells whether line 64 w + i stays; words that keep all 64 lines are left out, as are documents that keep all.

    Only (96 hash bits, doc_id, position) of each line is shuffled. A key's surviving document comes from map-side
    aggregates, and the occurrences meet it in a sort-merge join whose hot keys Spark can split; a window over the
    occurrences of a key would put a passage that a third of all documents share into one task.

    Null or empty text is one empty line. A null doc_id counts as a document smaller than all others (if a key is only in
    such rows, its lines stay). Rows that repeat a doc_id count as one document.
    """
    keys = F.split(F.translate(_text(), _UPPER, _LOWER), "\n")
    found = F.transform(keys, lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(_BLANKS)).alias("key")))
    hashed = F.transform(F.filter(found, lambda x: F.char_length(x["key"]) >= min_chars), lambda x: F.struct(F.xxhash64(x["key"]).alias("h"), F.hash(x["key"]).alias("g"), x["pos"].alias("pos")))
    lines = docs.select("doc_id", _row_key().alias("row_key"), F.inline(hashed))
    survivors = (
        lines.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("kept_in"))
        .filter((F.col("n") >= min_docs) & F.col("kept_in").isNotNull())
    )
    survivors = written(survivors, "survivors")  # as a table of its own it leaves the join free to split hot keys
    dropped = lines.join(survivors.drop("n"), ["h", "g"]).filter(~F.col("doc_id").eqNullSafe(F.col("kept_in")))
    words = (
        dropped.select("doc_id", "row_key", "pos").repartition("doc_id", "row_key")
        .groupBy("doc_id", "row_key", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("drop"))
    )
    return words.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits")))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with the lines that their bitmaps drop taken out of text; with ``counts`` adds n_lines (before) and n_dropped, in place of columns of that name.

    Other columns stay, whatever their names; a null text that loses no line stays null; repeated rows are cut each; an empty table stays empty.
    """
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    maps = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__row"), F.col("keep").alias("__keep"))
    both = docs.withColumn("__key", _row_key()).join(maps, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__row")), "left")
    lines = F.split(_text(), "\n")
    at = F.flatten(F.transform("__keep", lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * 64 + b)))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at), lambda i: F.get(lines, i)), "\n")
    lost = F.aggregate("__keep", F.lit(0).cast("long"), lambda n, w: n + 64 - F.bit_count(w["bits"]))
    counted = [F.size(lines).cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0).cast("long")).alias("n_dropped")] if counts else []
    return both.select(*[F.when(F.col("__keep").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in names], *counted)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points that three or more ``documents`` share stay in the largest doc_id only."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, line_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(_text(), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
k AS (SELECT key, max(doc_id) AS kept_in FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, k.kept_in IS NOT NULL AND k.kept_in <> l.doc_id AS dropped FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
