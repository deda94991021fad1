"""Names and weights of GPU models."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULTS, MIG = "__DEFAULTS__", "__MIG__"
_SLICE = re.compile(r"\d+g\.\d+gb")
#: Listed weights of slices, and else the share of the whole model, by the number of compute parts.
SLICES = {
    "H100-SXM5-80GB": ({1: 1.74, 2: 3.48, 3: 6.1}, {1: 1 / 8, 2: 2 / 8, 3: 5 / 11, 4: 1 / 2}),
    "A100-SXM4-40GB": ({}, {1: 1 / 7, 2: 2 / 7, 3: 3 / 7, 4: 4 / 7}),
    "A100-SXM4-80GB": ({}, {1: 1 / 7, 2: 2 / 7, 3: 3 / 7, 4: 4 / 7}),
}


def flatten_names(names: dict[str, dict[str, str]]) -> list[tuple[str, str, str]]:
    """(node, raw, name) of every raw name on every node, where a name may point to another raw name (``$raw``) or be a slice of one (``__MIG__raw``).

    Defaults fill what a node leaves out. Entries that name a model are known; in rounds, pointers take the name of what they point to and slices that of their
    parent with the slice behind, until no more entries become known. What points in a circle or to nothing has no name, nor have slices of it.
    """
    defaults = names.get(DEFAULTS, {})
    table = {(node, raw): entry for node, own in names.items() for raw, entry in {**defaults, **own}.items()}
    if odd := next((raw for (_, raw), entry in table.items() if entry.startswith(MIG) and not _SLICE.fullmatch(raw)), None):
        raise ValueError(f"not a slice of a GPU: {odd}")
    known = {k: entry for k, entry in table.items() if not entry.startswith(("$", MIG))}
    waiting = {(node, raw): ((node, entry.removeprefix(MIG).removeprefix("$")), f" : {raw}" if entry.startswith(MIG) else "") for (node, raw), entry in table.items() if (node, raw) not in known}
    while ready := {k: known[to] + behind for k, (to, behind) in waiting.items() if to in known}:
        known |= ready
        waiting = {k: x for k, x in waiting.items() if k not in ready}
    return sorted((node, raw, name) for (node, raw), name in known.items())


def raw_key(raw: Column) -> Column:
    """Raw names as the map has them: lower case, dashes for blanks, without ``gpu:``."""
    x = F.replace(F.lower(raw), F.lit(" "), F.lit("-"))
    return F.when(F.startswith(x, F.lit("gpu:")), F.split_part(x, F.lit(":"), F.lit(2))).otherwise(x)


def harmonize(jobs: DataFrame, names: dict[str, dict[str, str]], raw: str = "allocated_gpu_type", column: str = "gpu_name") -> DataFrame:
    """Jobs with the one GPU name that their nodes (or, without nodes, the defaults) give their raw type; null if there is none or several."""
    spark: SparkSession = jobs.sparkSession
    table = F.broadcast(spark.createDataFrame(flatten_names(names), "node string, raw string, name string"))  # configuration
    nodes = F.when(F.size("nodes") > 0, F.col("nodes")).otherwise(F.array(F.lit("")))
    each = jobs.filter(F.col(raw).isNotNull()).select("job_db_id", F.explode(nodes).alias("node"), raw_key(F.col(raw)).alias("raw"))
    own = each.join(table, ["node", "raw"], "left")
    other = table.filter(F.col("node") == DEFAULTS).select("raw", F.col("name").alias("default_name"))
    named = own.join(F.broadcast(other), "raw", "left").select("job_db_id", F.coalesce("name", "default_name").alias("name"))
    one = named.groupBy("job_db_id").agg(F.collect_set("name").alias("s")).select("job_db_id", F.when(F.size("s") == 1, F.col("s")[0]).alias(column))
    return jobs.join(one, "job_db_id", "left")


def infer_gpu_type(
    jobs: DataFrame, node_gpus: DataFrame, names: dict[str, dict[str, str]] | None = None, sample_labels: DataFrame | None = None, column: str = "inferred_gpu_type", harmonized: str = "gpu_name",
) -> DataFrame:
    """GPU jobs: the type that the job's samples name (``sample_labels``: job_db_id, gpu_type), else the one type that its nodes have (node_gpus: job_db_id, node_to_gpu map), else the recorded one.

    With ``names`` the result is harmonized too (:func:`harmonize`), as column ``harmonized``. Jobs without GPUs keep their recorded type.
    """
    found = jobs.filter(F.col("allocated_gres_gpu").isNotNull()).join(node_gpus, "job_db_id", "left")
    kinds = F.array_distinct(F.flatten(F.transform("nodes", lambda n: F.coalesce(F.col("node_to_gpu")[n], F.array().cast("array<string>")))))
    one = found.select("job_db_id", F.when(F.size(kinds) == 1, kinds[0]).alias("__one"))
    out = jobs.join(one, "job_db_id", "left")
    label = F.lit(None).cast("string")
    if sample_labels is not None:  # a job has one label; should its series differ, the least counts, so that reruns agree
        said = sample_labels.filter("gpu_type IS NOT NULL").groupBy("job_db_id").agg(F.min("gpu_type").alias("__said"))
        out, label = out.join(said, "job_db_id", "left"), F.when(F.col("allocated_gres_gpu").isNotNull(), F.col("__said"))
    out = out.withColumn(column, F.coalesce(label, "__one", "allocated_gpu_type")).drop("__one", "__said")
    return out if names is None else harmonize(out, names, column, harmonized)


def slice_weights(spark: SparkSession, slices: dict[str, tuple[dict[int, float], dict[int, float]]] = SLICES) -> DataFrame:
    """(parent, part, listed, share) of ``slices`` as a table: configuration."""
    rows = [(parent, n, listed.get(n), shares.get(n)) for parent, (listed, shares) in slices.items() for n in sorted({*listed, *shares})]
    return spark.createDataFrame(rows, "parent string, part int, listed double, share double")


def gpu_weight(models: DataFrame, weights: DataFrame, slices: DataFrame | None = None, use_listed: bool = True) -> DataFrame:
    """Weights of model names, slices (``parent : 2g.10gb``) included: a slice's listed weight (if ``use_listed``), else its share of the parent's weight. Unknown models, parents and parts have none."""
    w = F.broadcast(weights.select(F.col("name").alias("w_name"), "rgu"))
    s = F.broadcast(slices if slices is not None else slice_weights(models.sparkSession))
    parent, part = F.trim(F.split_part("name", F.lit(":"), F.lit(1))), F.nullif(F.regexp_extract("name", r":\s*(\d+)g\.\d+gb", 1), F.lit("")).cast("int")
    both = models.withColumn("parent", parent).withColumn("part", part).join(w, F.col("parent") == F.col("w_name"), "left").join(s, ["parent", "part"], "left")
    of_slice = F.coalesce(F.col("listed") if use_listed else F.lit(None).cast("double"), F.col("rgu") * F.col("share"))
    return both.select("name", F.when(~F.contains("name", F.lit(":")), F.col("rgu")).otherwise(of_slice).alias("weight"))


def compound_names(named: DataFrame, weights: DataFrame) -> DataFrame:
    """Jobs with several GPU names (job_db_id, names array): one joined name with its weight if all names weigh the same; status tells."""
    w = F.broadcast(weights.select(F.col("name").alias("n"), F.struct("rgu", "drac_rgu").alias("w")))
    each = named.select("job_db_id", F.explode(F.array_distinct("names")).alias("n")).join(w, "n", "left")
    out = each.groupBy("job_db_id").agg(F.array_join(F.sort_array(F.collect_list("n")), "+").alias("name"), F.collect_set("w").alias("ws"), F.max(F.col("w").isNull()).alias("unknown"))
    status = F.when(F.col("unknown"), "unknown").when(F.size("ws") > 1, "different").otherwise("joined")
    return out.select("job_db_id", "name", status.alias("status"), F.when(status == "joined", F.col("ws")[0]["rgu"]).alias("rgu"))
