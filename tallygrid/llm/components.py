"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v long): root is the smallest node that it reaches.

    A large-star round links the larger neighbours of each node to its smallest neighbour, a small-star round the
    smaller ones; both keep the components, and after O(log^2 n) rounds each is a star around its smallest
    node: the loop ends when a round changes nothing. Each round is written to the shared folder, so lineage stays short and survives lost executors. The
    smallest neighbour is a map-side aggregate joined back, so hubs can be split.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    sign = None
    while True:
        new = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.hash("u", "v"))).first())
        if new == sign or not new[0]:
            break
        sign = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k"))
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
