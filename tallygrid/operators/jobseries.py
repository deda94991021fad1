"""The wide job table: one row per job with owner, weights, statistics, costs and waste; and filters over jobs."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.functions.timeaxis import epoch, seconds

STAT_NAMES = ("gpu_utilization", "gpu_sm_occupancy", "cpu_utilization", "gpu_memory", "system_memory")
STAT_FIELDS = ("mean", "std", "q05", "q25", "median", "q75", "max")


def real(x: Column) -> Column:
    """A number: neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x)


def nan_to(x: Column, value=None) -> Column:
    """NaN as null, or as ``value``."""
    return F.when(F.isnan(x), F.lit(value)).otherwise(x)


def valid_metric(x: Column) -> Column:
    return real(x) & (x >= 0)


def gpu_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that hold GPUs of a known type."""
    return jobs.filter((F.col("allocated_gres_gpu") > 0) & F.col("harmonized_gpu_type").isNotNull())


def with_weights(jobs: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds rgu and drac_rgu of the job's GPU type; the weight table has a row per GPU model."""
    w = weights.select(F.col("name").alias("harmonized_gpu_type"), "rgu", "drac_rgu")
    return jobs.join(w, "harmonized_gpu_type", "left")


def with_statistic(jobs: DataFrame, stats: DataFrame, name: str, fields: Iterable[str] = ("mean",), how: str = "left") -> DataFrame:
    """Adds ``name``_field columns of one statistic by (job_db_id, name)."""
    own = stats.filter(F.col("name") == name).select(F.col("job_id").alias("job_db_id"), *[F.col(f).alias(f"{name}_{f}") for f in fields])
    return jobs.join(own, "job_db_id", how)


def pivot_statistics(stats: DataFrame, names: Iterable[str], fields: Iterable[str]) -> DataFrame:
    """One row per job with name_field columns: one aggregation in place of a join per name."""
    names = list(names)
    picked = [F.max(F.when(F.col("name") == n, F.struct(F.col(f).alias("v")))).getField("v").alias(f"{n}_{f}") for n in names for f in fields]
    return stats.filter(F.col("name").isin(names)).groupBy(F.col("job_id").alias("job_db_id")).agg(*picked)


def cost_columns() -> dict[str, Column]:
    """The derived columns by name; a missing statistic leaves waste null."""
    gpus, asked = F.col("allocated_gres_gpu"), F.col("requested_gres_gpu")
    elapsed, drac = F.col("elapsed_time"), F.col("drac_rgu")
    cpu, gpu = elapsed * F.col("allocated_cpu"), elapsed * gpus * drac
    return {
        "allocated_rgu": F.coalesce(gpus, F.lit(0)) * F.col("rgu"), "requested_rgu": F.coalesce(asked, F.lit(0)) * F.col("rgu"),
        "allocated_drac_rgu": F.coalesce(gpus, F.lit(0)) * drac, "requested_drac_rgu": F.coalesce(asked, F.lit(0)) * drac,
        "cpu_cost": cpu, "cpu_waste": (1 - F.col("cpu_utilization_mean")) * cpu, "cpu_overbilling": elapsed * (F.col("allocated_cpu") - F.col("requested_cpu")),
        "gpu_cost": gpu, "gpu_waste": (1 - F.col("gpu_sm_occupancy_mean")) * gpu, "gpu_overbilling": elapsed * drac * (gpus - asked),
    }


#: What the derived columns take from joined tables.
_COST_NEEDS = {
    "allocated_rgu": {"rgu"}, "requested_rgu": {"rgu"}, "allocated_drac_rgu": {"drac_rgu"}, "requested_drac_rgu": {"drac_rgu"}, "cpu_waste": {"cpu_utilization_mean"},
    "gpu_cost": {"drac_rgu"}, "gpu_waste": {"drac_rgu", "gpu_sm_occupancy_mean"}, "gpu_overbilling": {"drac_rgu"},
}
_NEEDS = {"users": {"display_name", "email"}, "clusters": {"cluster_name", "domain"}}


def job_series(jobs: DataFrame, stats: DataFrame, weights: DataFrame, users: DataFrame, clusters: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The wide table, or only ``columns`` of it: a dimension that no column needs is not joined. An unknown column is an error."""
    derived = cost_columns()
    stat_columns = [f"{n}_{f}" for n in STAT_NAMES for f in ("mean", "median", "max")]
    known = [*jobs.columns, "rgu", "drac_rgu", *stat_columns, *sorted(_NEEDS["users"] | _NEEDS["clusters"]), *derived]
    asked = list(columns) if columns is not None else known
    if unknown := set(asked) - set(known):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    need = set(asked)
    for name in need & derived.keys():
        need = need | _COST_NEEDS.get(name, set())
    out = jobs
    if need & {"rgu", "drac_rgu"}:
        out = with_weights(out, F.broadcast(weights))
    if found := [c for c in stat_columns if c in need]:
        names = sorted({c.rsplit("_", 1)[0] for c in found})
        out = out.join(pivot_statistics(stats, names, ("mean", "median", "max")).select("job_db_id", *found), "job_db_id", "left")
    if need & _NEEDS["users"]:
        out = out.join(users.select(F.col("id").alias("user_id"), "display_name", "email"), "user_id", "left")
    if need & _NEEDS["clusters"]:
        out = out.join(F.broadcast(clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name"), "domain")), "cluster_id", "left")
    return out.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in asked])


def nested_statistics(jobs: DataFrame, stats: DataFrame) -> DataFrame:
    """Jobs with a map of statistic name to its seven numbers; missing numbers are NaN, a job without statistics has an empty map."""
    numbers = F.struct(*[F.coalesce(F.col(f), F.lit(float("nan"))).alias(f) for f in STAT_FIELDS])
    maps = stats.groupBy(F.col("job_id").alias("job_db_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", numbers.alias("value"))))).alias("statistics"))
    return jobs.join(maps, "job_db_id", "left").withColumn("statistics", F.coalesce("statistics", F.create_map().cast(maps.schema["statistics"].dataType)))


def analysis_frame(jobs: DataFrame, stats: DataFrame, now: datetime) -> DataFrame:
    """Jobs ready for slicing over time: open ends closed at ``now``, medians (memory: maxima) flat, GPU utilization over 1 as NaN."""
    flat = pivot_statistics(stats, STAT_NAMES, ("median", "max"))
    values = [F.col(f"{n}_{'max' if n == 'system_memory' else 'median'}").alias(n) for n in STAT_NAMES]
    flat = flat.select("job_db_id", *values)
    flat = flat.withColumn("gpu_utilization", F.when(F.col("gpu_utilization") > 1, F.lit(float("nan"))).otherwise(F.col("gpu_utilization")))
    return jobs.join(flat, "job_db_id", "left").withColumn("end_time", F.coalesce("end_time", F.lit(now).cast("timestamp")))


def filter_jobs(
    jobs: DataFrame, *, cluster: str | None = None, job_ids: Iterable[int] | None = None, state: str | None = None, email: str | None = None, user_id: int | None = None,
    cluster_user: str | None = None, start: datetime | None = None, end: datetime | None = None, clusters: DataFrame | None = None, users: DataFrame | None = None,
) -> DataFrame:
    """Jobs that meet every given condition; an empty list of ids matches nothing. ``start``/``end``: still running after start, submitted before end."""
    out = jobs
    if cluster is not None:
        out = out.join(F.broadcast(clusters.filter(F.col("name") == cluster).select(F.col("id").alias("cluster_id"))), "cluster_id", "left_semi")
    if job_ids is not None:
        ids = list(job_ids)
        out = out.filter(F.col("job_id").isin(ids) if ids else F.lit(False))
    for column, value in (("job_state", state), ("user_id", user_id), ("cluster_user", cluster_user)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if email is not None:
        out = out.join(users.filter(F.col("email") == email).select(F.col("id").alias("user_id")), "user_id", "left_semi")
    if end is not None:
        out = out.filter(seconds(F.col("submit_time")) < epoch(end))
    if start is not None:
        out = out.filter(F.col("end_time").isNull() | (seconds(F.col("end_time")) > epoch(start)))
    return out


def count_jobs(jobs: DataFrame, **conditions) -> DataFrame:
    return filter_jobs(jobs, **conditions).agg(F.count("*").alias("n"))


def common_filters(jobs: DataFrame, states: list[str] | None = None, cluster_ids: list[int] | None = None, login: str | None = None, owner: int | None = None, known_clusters: Iterable[int] | None = None) -> DataFrame:
    """The filters every report shares; an unknown cluster is an error, ``owner`` None sees all jobs."""
    if cluster_ids and known_clusters is not None and set(cluster_ids) - set(known_clusters):
        raise ValueError(f"unknown clusters: {sorted(set(cluster_ids) - set(known_clusters))}")
    out = jobs
    for column, values in (("job_state", states), ("cluster_id", cluster_ids)):
        if values:
            out = out.filter(F.col(column).isin(list(values)))
    if login:
        out = out.filter(F.col("cluster_user") == login)
    return out if owner is None else out.filter(F.col("user_id") == owner)


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:
    """The one row with ``column = value``; a missing one is an error."""
    found = df.filter(F.col(column) == value)
    if found.isEmpty():
        raise LookupError(f"no row with {column} = {value!r}")
    return found


def union_clusters(frames: Iterable[DataFrame]) -> DataFrame:
    """Frames of several clusters stacked by column name; missing columns are null."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def frame_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows that differ between two job frames by ``key``, and in which columns; lists are compared sorted, NaN as null."""
    def plain(df: DataFrame, tag: str) -> DataFrame:
        cols = []
        for name, kind in df.dtypes:
            c = F.col(name)
            if kind.startswith("array"):
                c = F.array_sort(c)
            elif kind in ("double", "float"):
                c = nan_to(c)
            cols.append(c.alias(f"{name}{tag}"))
        return df.select(*cols, F.lit(True).alias(f"has{tag}"))

    names = [c for c in left.columns if c != key and c in right.columns]
    both = plain(left, "_l").join(plain(right, "_r"), F.col(f"{key}_l") == F.col(f"{key}_r"), "full_outer")
    present = F.col("has_l").isNotNull() & F.col("has_r").isNotNull()
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")), F.lit(c)) for c in names]))
    status = F.when(F.col("has_r").isNull(), F.lit("left only")).when(F.col("has_l").isNull(), F.lit("right only")).otherwise(F.array_join(wrong, ","))
    return both.select(F.coalesce(f"{key}_l", f"{key}_r").alias(key), status.alias("difference"), present.alias("in_both")).filter((F.col("difference") != "") | ~F.col("in_both"))
