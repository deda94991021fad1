"""Dashboard queries: spans of jobs over buckets, distributions, rankings, pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.functions.ranges import SHALLOW, page_of
from tallygrid.functions.timeaxis import Axis, epoch, overlap_hours, ran_between, seconds, span_to_buckets
from tallygrid.operators.jobseries import gpu_jobs, nan_to, pivot_statistics, real, valid_metric, with_statistic, with_weights


def _dense(axis: Axis, found: DataFrame, zeros: list[str] = ()) -> DataFrame:
    """Every bucket of the axis; missing counts as ``zeros``."""
    frame = axis.frame(found.sparkSession)
    out = frame.select("bucket", F.col("lo_s").alias("bucket_s"), "hi_s").join(F.broadcast(found), "bucket", "left")
    return out.select("bucket_s", *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zeros else F.col(c) for c in found.columns if c != "bucket"])


def job_counts(jobs: DataFrame, axis: Axis, submitted: bool = False) -> DataFrame:
    """Jobs per bucket: those running in it (once in each), or those submitted in it. Empty buckets are 0."""
    if submitted:
        s = seconds(F.col("submit_time"))
        each = jobs.filter((s >= epoch(axis.begin)) & (s < epoch(axis.finish))).withColumn("bucket", axis.index(s))
    else:
        each = span_to_buckets(jobs, axis)
    return _dense(axis, each.groupBy("bucket").agg(F.count("*").alias("n_jobs")), ["n_jobs"])


#: The metrics whose means accompany every usage report.
TRENDS = ("gpu_sm_occupancy", "gpu_utilization")


def rgu_usage(jobs: DataFrame, stats: DataFrame, weights: DataFrame, axis: Axis, metric: str = "gpu_sm_occupancy", minimum: float = 0.0) -> DataFrame:
    """Weighted GPU hours per bucket: allocated, used (x mean), unmeasured (no mean), wasted (below ``minimum``), and for each of ``TRENDS``, whatever ``metric`` is, the plain average over jobs of its mean, as <name>_mean.

    The statistics of all metrics come from one aggregate and one join.
    """
    means = pivot_statistics(stats, dict.fromkeys((metric, *TRENDS)), ("mean",))
    runs = gpu_jobs(jobs).filter(ran_between(axis.begin, axis.finish)).join(means, "job_db_id", "left")
    each = span_to_buckets(with_weights(runs, F.broadcast(weights)), axis)
    mean = F.col(f"{metric}_mean")
    hours = F.col("allocated_gres_gpu") * F.col("rgu") * F.col("overlap_h")
    trends = [F.avg(F.when(real(F.col(f"{name}_mean")), F.col(f"{name}_mean"))).alias(f"{name}_mean") for name in TRENDS]
    found = each.groupBy("bucket").agg(
        F.sum(hours).alias("allocated"), F.sum(F.when(real(mean), hours * mean)).alias("used"), F.sum(F.when(~F.coalesce(real(mean), F.lit(False)), hours)).alias("unmeasured"),
        F.sum(F.when(real(mean) & (mean < minimum), hours * (minimum - mean))).alias("wasted"), *trends,
    )
    return _dense(axis, found, ["allocated", "used", "unmeasured", "wasted"])


def rgu_by_cluster(jobs: DataFrame, weights: DataFrame, axis: Axis) -> DataFrame:
    """Weighted GPU hours per (bucket, cluster) on a dense grid, with the cluster's total; clusters without hours are left out; largest cluster first."""
    each = span_to_buckets(with_weights(gpu_jobs(jobs), F.broadcast(weights)), axis)
    found = each.groupBy("bucket", "cluster_id").agg(F.sum(F.col("allocated_gres_gpu") * F.col("rgu") * F.col("overlap_h")).alias("rgu_hours"))
    totals = found.groupBy("cluster_id").agg(F.sum("rgu_hours").alias("total")).filter("total > 0")
    # a row per bucket and cluster: both lists are dimensions of a few rows
    grid = axis.frame(jobs.sparkSession).select("bucket", F.col("lo_s").alias("bucket_s")).withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one").drop("one")
    out = grid.join(found, ["bucket", "cluster_id"], "left").select("bucket_s", "cluster_id", F.coalesce("rgu_hours", F.lit(0.0)).alias("rgu_hours"), "total")
    return out.orderBy("bucket_s", F.col("total").desc(), "cluster_id")


def rgu_by_user(jobs: DataFrame, stats: DataFrame, weights: DataFrame, lo: datetime, hi: datetime, metric: str = "gpu_sm_occupancy", minimum: float = 0.15) -> DataFrame:
    """Requested, used, unmeasured and wasted (below ``minimum``) weighted hours per login over one window; no login: "unknown"."""
    runs = with_statistic(with_weights(gpu_jobs(jobs).filter(ran_between(lo, hi)), F.broadcast(weights)), stats, metric)
    s, mean = seconds(F.col("start_time")), F.col(f"{metric}_mean")
    hours = F.col("allocated_gres_gpu") * F.col("rgu") * overlap_hours(s, s + F.col("elapsed_time"), F.lit(epoch(lo)), F.lit(epoch(hi)))
    out = runs.groupBy(F.coalesce("cluster_user", F.lit("unknown")).alias("login")).agg(
        F.coalesce(F.sum(hours), F.lit(0.0)).alias("requested"), F.coalesce(F.sum(F.when(real(mean), hours * mean)), F.lit(0.0)).alias("used"),
        F.coalesce(F.sum(F.when(~F.coalesce(real(mean), F.lit(False)), hours)), F.lit(0.0)).alias("unmeasured"),
        F.coalesce(F.sum(F.when(real(mean) & (mean < minimum), hours * (minimum - mean))), F.lit(0.0)).alias("wasted"), F.count("*").alias("n_jobs"),
    )
    return out.orderBy(F.col("requested").desc(), "login")


def metric_trend(jobs: DataFrame, stats: DataFrame, axis: Axis, metric: str) -> DataFrame:
    """Averages of per-job mean and max per bucket over GPU jobs that have the metric; a bucket without any is null."""
    each = span_to_buckets(with_statistic(gpu_jobs(jobs).filter(ran_between(axis.begin, axis.finish)), stats, metric, ("mean", "max"), "inner"), axis)
    mean, top = F.col(f"{metric}_mean"), F.col(f"{metric}_max")
    return _dense(axis, each.groupBy("bucket").agg(F.avg(F.when(real(mean), mean)).alias("avg_mean"), F.avg(F.when(real(top), top)).alias("avg_max")))


def _bin(x, n: int):
    return F.least(F.greatest(F.floor(x * n), F.lit(0)), F.lit(n - 1)).cast("int")


def metric_distribution(jobs: DataFrame, stats: DataFrame, weights: DataFrame, lo: datetime, hi: datetime, metric: str, bins: int = 50) -> DataFrame:
    """Weighted GPU seconds inside the window by bins of the metric's mean on [0, 1]; the bin's centre."""
    runs = with_statistic(with_weights(gpu_jobs(jobs).filter(ran_between(lo, hi)), F.broadcast(weights)), stats, metric, how="inner")
    s, x = seconds(F.col("start_time")), F.col(f"{metric}_mean")
    weight = F.col("allocated_gres_gpu") * F.col("rgu") * overlap_hours(s, s + F.col("elapsed_time"), F.lit(epoch(lo)), F.lit(epoch(hi))) * 3600
    found = runs.filter(valid_metric(x)).groupBy(_bin(x, bins).alias("bin")).agg(F.sum(weight).alias("rgu_seconds"))
    return found.withColumn("centre", (F.col("bin") + 0.5) / bins)


def metric_comparison(jobs: DataFrame, stats: DataFrame, lo: datetime, hi: datetime, a: str, b: str, bins: int = 100) -> DataFrame:
    """Counts of jobs by bins of two metrics; jobs need both."""
    runs = gpu_jobs(jobs).filter(ran_between(lo, hi))
    both = with_statistic(with_statistic(runs, stats, a, how="inner"), stats, b, how="inner").filter(valid_metric(F.col(f"{a}_mean")) & valid_metric(F.col(f"{b}_mean")))
    return both.groupBy(_bin(F.col(f"{a}_mean"), bins).alias("bin_a"), _bin(F.col(f"{b}_mean"), bins).alias("bin_b")).agg(F.count("*").alias("n_jobs"))


def time_vs_limit(jobs: DataFrame, lo: datetime, hi: datetime, bins: int = 100) -> DataFrame:
    """Counts by log-scaled bins of (elapsed time or wait, time limit), with the bins' centres, for jobs submitted in the window that have a limit and started."""
    s = seconds(F.col("submit_time"))
    picked = jobs.filter((s >= epoch(lo)) & (s < epoch(hi)) & F.col("time_limit").isNotNull() & F.col("start_time").isNotNull()).select(
        F.col("elapsed_time").alias("elapsed"), (seconds(F.col("start_time")) - s).alias("wait"), F.col("time_limit").cast("double").alias("limit"), F.lit(1).alias("one"))
    tops = picked.agg(*[F.greatest(F.max(c), F.lit(1e-9)).alias(f"top_{c}") for c in ("elapsed", "wait", "limit")]).withColumn("one", F.lit(1))
    both = picked.join(F.broadcast(tops), "one")  # one row of maxima

    def log_bin(c: str):
        return F.least(F.greatest(F.floor(F.log10(F.col(c) + 1) * bins / F.log10(F.col(f"top_{c}") + 1)), F.lit(0)), F.lit(bins - 1)).cast("int")

    def centre(c: str):
        return F.pow(F.lit(10.0), (log_bin(c) + 0.5) * F.log10(F.col(f"top_{c}") + 1) / bins) - 1

    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), log_bin(k).alias("bin"), centre(k).alias("centre")) for k in ("elapsed", "wait")]))
    return both.select(pairs.alias("p"), log_bin("limit").alias("bin_limit"), centre("limit").alias("centre_limit")).groupBy("p.kind", "p.bin", "p.centre", "bin_limit", "centre_limit").agg(F.count("*").alias("n_jobs"))


#: What a page of jobs can be sorted by, and the column of each key.
SORT_KEYS = {
    "cluster": "cluster_name", "job_id": "job_id", "submit_time": "submit_time", "start_time": "start_time", "user": "cluster_user", "job_state": "job_state", "elapsed": "elapsed_h",
    "requested_gpu": "requested_gres_gpu", "allocated_gpu": "allocated_gres_gpu", "billing": "allocated_billing", "gpu_type": "gpu_type", "gpu_type_rgu": "gpu_type_rgu", "rgu": "rgu", "rgu_hours": "rgu_hours",
    "waste": "waste", "gpu_utilization_mean": "gpu_utilization_mean", "gpu_sm_occupancy_mean": "gpu_sm_occupancy_mean", "gpu_memory_max": "gpu_memory_max",
}
#: Statistics that stand beside a page, and the field shown of each.
_SHOWN = {"gpu_utilization": "mean", "gpu_sm_occupancy": "mean", "gpu_memory": "max"}


def _window_jobs(jobs: DataFrame, lo: datetime, hi: datetime) -> DataFrame:
    return gpu_jobs(jobs).filter(ran_between(lo, hi))


def jobs_total(jobs: DataFrame, lo: datetime, hi: datetime) -> DataFrame:
    """One row: how many jobs all pages of :func:`jobs_table` hold; neither weights nor statistics are read for it."""
    return _window_jobs(jobs, lo, hi).agg(F.count("*").alias("total"))


def jobs_table(jobs: DataFrame, stats: DataFrame, weights: DataFrame, lo: datetime, hi: datetime, sort: str = "rgu_hours", descending: bool = True, limit: int = 50, offset: int = 0, metric: str = "gpu_sm_occupancy", clusters: DataFrame | None = None) -> DataFrame:
    """A page of the window's GPU jobs: hours and weighted hours clipped to the window, the whole elapsed time, waste by ``metric``, three statistics; an unknown ``sort`` is rgu_hours, nulls last, ties by id.

    The page is found once (:func:`tallygrid.functions.ranges.page_of`), with the one statistic that the order needs, if any; the shown statistics are joined to the page only. A deep page sorts only the ranges of the order that hold it.
    """
    s = seconds(F.col("start_time"))
    runs = with_weights(_window_jobs(jobs, lo, hi), F.broadcast(weights)).withColumnRenamed("rgu", "gpu_type_rgu")
    named = F.col("cluster_id").cast("string").alias("cluster_name")
    runs = runs.join(clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name")), "cluster_id", "left") if clusters is not None else runs.select("*", named)
    runs = runs.withColumn("elapsed_h", overlap_hours(s, s + F.col("elapsed_time"), F.lit(epoch(lo)), F.lit(epoch(hi)))).withColumn("rgu", F.col("allocated_gres_gpu") * F.col("gpu_type_rgu"))
    runs = runs.withColumn("rgu_hours", F.col("rgu") * F.col("elapsed_h")).withColumn("gpu_type", F.coalesce("harmonized_gpu_type", "allocated_gpu_type"))
    key = SORT_KEYS.get(sort, "rgu_hours")
    name, field = (metric, "mean") if key == "waste" else key.rsplit("_", 1) if key.rsplit("_", 1)[0] in _SHOWN else (None, None)
    if name:
        runs = with_statistic(runs, stats, name, (field,)).withColumnRenamed(f"{name}_{field}", "__stat")
    by = F.col("rgu_hours") * (1 - F.col("__stat")) if key == "waste" else F.col("__stat") if name else F.col(key)
    runs = runs.withColumn("__by", by)
    order = [F.col("__by").desc_nulls_last() if descending else F.col("__by").asc_nulls_last(), F.col("job_db_id")]
    if offset + limit <= SHALLOW:
        page = page_of(runs, order, offset, limit, "__at")
    else:  # the place of each row is found on two columns; the page's rows, a bounded number, then meet the others
        found = page_of(runs.select("job_db_id", "__by"), order, offset, limit, "__at").select("job_db_id", "__at")
        page = runs.join(F.broadcast(found), "job_db_id")
    ids = page.select(F.col("job_db_id").alias("job_id"))  # limit rows at most
    shown = pivot_statistics(stats.join(F.broadcast(ids), "job_id", "left_semi"), dict.fromkeys((*_SHOWN, metric)), ("mean", "max"))
    both = page.join(shown, "job_db_id", "left")
    mean = nan_to(F.col(f"{metric}_mean"))
    return both.select(
        "job_db_id", "cluster_name", page["job_id"], "submit_time", "start_time", "cluster_user", "job_state", "elapsed_h", F.col("elapsed_time").alias("elapsed_total"), F.array_join("nodes", ", ").alias("nodes"),
        "requested_gres_gpu", "allocated_gres_gpu", "allocated_billing", "gpu_type", "gpu_type_rgu", "rgu", "rgu_hours", (F.col("rgu_hours") * (1 - mean)).alias("waste"), mean.alias("metric_mean"),
        nan_to(F.col("gpu_utilization_mean"), -1.0).alias("gpu_utilization_mean"), nan_to(F.col("gpu_sm_occupancy_mean"), -1.0).alias("gpu_sm_occupancy_mean"), nan_to(F.col("gpu_memory_max")).alias("gpu_memory_max"), "__at",
    ).orderBy("__at").drop("__at")


def keyset_page(jobs: DataFrame, after: tuple[int, datetime | None] | None = None, limit: int = 100) -> DataFrame:
    """The next page, newest submission first, ties by id; ``after`` is (id, time) of the last row seen, or (id, None)."""
    out = jobs
    if after:
        job, at = after
        t = seconds(F.col("submit_time"))
        out = out.filter(F.col("job_db_id") > job) if at is None else out.filter((t < epoch(at)) | ((t == epoch(at)) & (F.col("job_db_id") > job)))
    return out.orderBy(F.col("submit_time").desc(), "job_db_id").limit(limit)


def rank_within(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
