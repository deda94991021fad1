"""Exact top-k search by inner product with MaxScore pruning over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.llm.shared import reach_workers, read_table

#: Rows of a shard and of a block of queries: a task holds one of each.
SHARD_ROWS, BLOCK_ROWS = 8192, 4096
#: Rows that are traversed between two looks at the threshold, and terms that are probed between two looks at the bounds.
ROWS, TERMS = 1024, 8
_EXACT = float(1 << 53)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x value): doubles where all of them are exact, else Python integers of any size."""
    with np.errstate(over="ignore"):
        product = values * scale
    if np.abs(product).max(initial=0) < _EXACT:
        return np.floor(product)
    return np.array([int(x) * scale if abs(x) >= _EXACT else int(np.floor(x * scale)) for x in values.ravel().tolist()], object).reshape(values.shape)


def maxscore(shard: np.ndarray, ids: np.ndarray, query_id: int, query: np.ndarray, k: int, count: list[int] | None = None) -> list[tuple[int, int]]:
    """The best ``k`` (vec_id, score) of one query within a shard of whole numbers, ties to smaller ids, the query's own id left out.

    Dimensions are the query's terms, a shard's columns their postings. Each term adds at least its least product to any score; its bound is
    how much more it can add. In order of bounds, the last terms that together cannot lift a row over the k-th best score so far are
    non-essential. ``ROWS`` rows at a time, the postings of the essential terms are traversed for all rows; the other terms are probed, greatest
    bound first, only for rows that can still compete. The threshold rises after each lot of rows, and more terms become non-essential.
    ``count`` collects the numbers of traversed and probed postings.
    """
    q = query.astype(shard.dtype)
    ends = np.stack([q * shard.max(axis=0), q * shard.min(axis=0)])
    least = ends.min(axis=0)
    bound = ends.max(axis=0) - least
    order = np.array(sorted(range(len(q)), key=lambda t: -bound[t]), int)
    floor = least.sum()
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], bound[:0].sum())  # what terms from here on add at most
    best: list[tuple[int, int]] = []  # (-score, vec_id), sorted
    for at in range(0, len(ids), ROWS):
        rows = np.flatnonzero(ids[at : at + ROWS] != query_id) + at
        full = len(best) == k
        threshold = -best[-1][0] if full else None
        essential = next((n for n in range(len(order) + 1) if floor + rest[n] < threshold), len(order)) if full else len(order)
        lead = order[:essential]
        score = floor + (shard[np.ix_(rows, lead)].dot(q[lead]) - least[lead].sum() if essential else np.zeros(len(rows), shard.dtype))
        seen = [len(rows) * essential, 0]
        for n in range(essential, len(order) + 1, TERMS):
            if full:
                keep = score + rest[min(n, len(order))] >= threshold
                rows, score = rows[keep], score[keep]
            terms = order[n : n + TERMS]
            if not len(rows) or not len(terms):
                break
            score = score + (shard[np.ix_(rows, terms)].dot(q[terms]) - least[terms].sum())
            seen[1] += len(rows) * len(terms)
        if len(rows) > k:  # ties of the k-th score stay for their ids
            cut = np.sort(score)[-k] if score.dtype != object else sorted(score.tolist())[-k]
            rows, score = rows[score >= cut], score[score >= cut]
        best = sorted([*best, *((-int(s), int(i)) for s, i in zip(score.tolist(), ids[rows].tolist(), strict=True))])[:k]
        if count is not None:
            count[0] += seen[0]
            count[1] += seen[1]
    return [(i, -s) for s, i in best]


def sortable(n: int) -> bytes:
    """Bytes that sort as the integers do, whatever their size."""
    size = (abs(n).bit_length() + 7) // 8
    own = size.to_bytes(2, "big") + abs(n).to_bytes(size, "big")
    return b"\1" + own if n >= 0 else b"\0" + bytes(255 - b for b in own)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the highest integer inner product for each of ``queries`` (same columns).

    Components become floor(scale x component), integers of any size. Rows whose vector is null, or holds null or non-finite components, take no part, nor do
    null ids; vectors of unlike lengths are never compared; a row with the query's own id is no candidate; rows that repeat an id are candidates each. Ranks follow exact scores; a score
    beyond a long is shown as its end. Other columns, whatever their names, are ignored; an empty table gives no rows.

    Shards of ``SHARD_ROWS`` vectors meet blocks of ``BLOCK_ROWS`` queries by a key of (block, shard): the query set is stated and a
    task holds one block and one shard. Each returns k rows per query (:func:`maxscore`), merged by rank.
    """
    reach_workers(vectors.sparkSession)

    def fine(df: DataFrame) -> DataFrame:
        numbers = F.col("embedding").cast("array<double>")
        taken = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.filter(taken).select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v"), F.size("embedding").alias("dim"))

    vectors, queries = fine(vectors), fine(queries)
    n_shards = max(1, -(-vectors.count() // SHARD_ROWS))
    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    shards = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            dim = key[2].as_py()

            def matrix(table: pa.Table) -> np.ndarray:
                return whole_numbers(table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), dim), scale)

            m, q = matrix(left), matrix(right)
            if m.dtype == object or q.dtype == object or dim and 4.0 * dim * np.abs(m).max() * np.abs(q).max() >= _EXACT:  # sums of doubles would round
                m, q = (x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape) for x in (m, q))
            ids = left["vec_id"].to_numpy()
            for query_id, query in zip(right["vec_id"].to_pylist(), q, strict=True):
                found += [(query_id, i, max(-(2**63), min(2**63 - 1, s)), sortable(s)) for i, s in maxscore(m, ids, query_id, query, k)]
        cols = zip(*found, strict=True) if found else ((), (), (), ())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table(dict(zip(("query_id", "vec_id", "score", "by"), (pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)), strict=True)))

    keys = ["shard", "block", "dim"]
    local = shards.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long, by binary")
    best = Window.partitionBy("query_id").orderBy(F.col("by").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_maxscore_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best of ``embeddings`` for every row whose vec_id is divisible by 50."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP8_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 50 = 0),
s AS (
  SELECT query_id, vec_id, CAST(list_dot_product(CAST(qv AS DOUBLE[]), CAST(v AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN e ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
