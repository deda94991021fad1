"""A cleaned, mixed and packed corpus in five stages; counted as part of ``tallygrid.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. In every stage null text counts as empty, a null doc_id or source is a value
of its own, texts may be of any length, repeated rows are judged each, an empty table gives an empty one, and extra columns stay, whatever their
names (two leading underscores excepted); packing reads doc_id, text and source and ignores the rest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.llm.lines import apply_bitmaps, line_bitmaps
from tallygrid.llm.mixing import mixed_documents
from tallygrid.llm.packing import digest, pack
from tallygrid.llm.shared import fresh_path, read_table
from tallygrid.llm.simhash import similar_documents
from tallygrid.llm.toxicity import learn, score

#: A document is rejected from this score on.
TOXIC = 0.5
#: Five-word shingle sets that overlap by so much make documents near copies.
SIMILARITY = 0.8


def _recounted(docs: DataFrame, names: list[str]) -> DataFrame:
    """n_chars of the texts as they are now."""
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select(*[n.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``TOXIC`` or more go. The labels of all labelled rows may teach here."""
    scored = score(docs, learn(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")), column="__score")
    return scored.filter(F.col("__score") < TOXIC).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points in three or more documents stay in the largest doc_id only."""
    return _recounted(apply_bitmaps(docs, line_bitmaps(docs), counts=False), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word SimHash links join, the one with the smallest doc_id stays (of rows that repeat it, all: they are one document)."""
    found = similar_documents(docs, width=5, similarity=SIMILARITY)
    leaders = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(leaders, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2 up to 150 % of all words, no document more than twice."""
    return _recounted(mixed_documents(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens at the sources' proportions in the mix; a row per piece."""
    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SimHash, the toxicity score and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
