"""The pipeline against brute force, and stage by stage on odd input."""

from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallygrid.llm import packing, simhash, toxicity
from tests.llm.test_corpus_ops import ODD, SCHEMA, SF, WORDS, check_pieces, overlap, rows, shingle_set


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, inputs = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = seen
        stage(spark, seen, SF).write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert seen.columns == docs.columns
    clean = {r["doc_id"] for r in rows(inputs["line dedup"])}
    scorer = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert clean == {r["doc_id"] for r in rows(toxicity.score(docs, scorer)) if r["score"] < corpus_pipeline.TOXIC}
    before = {r["doc_id"]: r["text"] for r in rows(inputs["SimHash near-dedup"])}
    sets, kept = {i: shingle_set(t) for i, t in before.items()}, {r["doc_id"] for r in rows(inputs["mixing"])}
    group = {r["doc_id"]: r["component_id"] for r in rows(simhash.similar_documents(inputs["SimHash near-dedup"]))}
    assert kept == set(group.values())
    near = [(i, j) for i, j in combinations(before, 2) if overlap(sets[i], sets[j]) >= corpus_pipeline.SIMILARITY]
    assert near and sum(group[i] == group[j] for i, j in near) >= 0.9 * len(near)
    for i in before.keys() - kept:  # only what a near copy stands for goes
        assert max(overlap(sets[i], sets[j]) for j in before if j != i and group[j] == group[i]) >= 0.8
    mixed = rows(inputs["packing"])
    got = rows(packing.pack(inputs["packing"], WORDS, 1))
    check_pieces(got, [(r["doc_id"], r["text"]) for r in mixed], packing.WINDOW)
    assert Counter((r["sequence_id"], r["offset"], r["length"]) for r in got) == Counter((r["sequence_id"], r["offset"], r["length"]) for r in rows(seen))


def test_run_equals_the_stages(spark):
    assert rows(corpus_pipeline.run(spark, SF).agg({"length": "sum"}))[0]["sum(length)"] > 10_000


@pytest.mark.parametrize("n", [0, len(ODD)])
def test_odd_documents_with_clashing_columns(spark, n, tmp_path):
    (tmp_path / "t").mkdir()
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), f"{tmp_path}/t/labels.parquet")
    extra = ["score", "keep", "n_lines", "n_dropped", "fp", "root", "node", "component_id", "words", "position", "queue", "ids", "tie"]
    seen = spark.createDataFrame(ODD[:n], SCHEMA).select("*", *[F.col("lang").alias(c) for c in extra], F.create_map(F.lit("a"), F.col("source")).alias("size"))
    columns = seen.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, f"{tmp_path}/t").write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "packing" or seen.columns == columns
    assert (seen.count() > 0) == (n > 0)


def test_toxicity_stage_cuts_no_more_texts_than_may_hit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    one_by_one, own = (toxicity.Scorer(model.precision, model.base, model.lm, model.common) for _ in range(2))
    given = rows(docs)
    scores = [one_by_one(r["text"]) for r in given]
    assert list(own.each(r["text"] for r in given)) == scores
    assert {r["doc_id"] for r in rows(corpus_pipeline.toxicity(spark, docs, SF))} == {r["doc_id"] for r, x in zip(given, scores) if x < corpus_pipeline.TOXIC}
    assert len(own.seen) < 0.5 * len(one_by_one.seen)
