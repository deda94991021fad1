"""Data-quality checks: each returns the rows that a report would name. ``now`` is always an argument."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.functions.timeaxis import effective_end, effective_start, epoch, frames_of, seconds


def clipped_seconds(lo: datetime, hi: datetime) -> Column:
    """Seconds of the effective span inside [lo, hi]."""
    return F.least(seconds(effective_end()), F.lit(epoch(hi))) - F.greatest(seconds(effective_start()), F.lit(epoch(lo)))


def jobs_missing_statistics(jobs: DataFrame, stats: DataFrame, attempts: DataFrame, cluster_id: int, cap: int | None = None) -> DataFrame:
    """Finished jobs of a cluster without any statistic that were never tried; newest first."""
    done = jobs.filter((F.col("cluster_id") == cluster_id) & (F.col("job_state") != "RUNNING") & (F.col("elapsed_time") != 0))
    for other in (stats, attempts):
        done = done.join(other.select(F.col("job_id").alias("job_db_id")), "job_db_id", "left_anti")
    out = done.orderBy(F.col("submit_time").desc(), "job_db_id")
    return out.limit(cap) if cap is not None else out


def jobs_missing_gpu_name(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("allocated_gpu_type").isNotNull() & F.col("harmonized_gpu_type").isNull())


def stale_clusters(clusters: DataFrame, column: str, now: datetime, after: timedelta) -> DataFrame:
    """Clusters last scraped before ``now - after``, or never."""
    return clusters.filter(F.col(column).isNull() | (seconds(F.col(column)) < epoch(now) - after.total_seconds()))


def old_running_jobs(jobs: DataFrame, now: datetime, since: datetime | None = None) -> DataFrame:
    """Jobs still running past their time limit."""
    over = (F.col("job_state") == "RUNNING") & F.col("time_limit").isNotNull() & (seconds(F.col("start_time")) + F.col("time_limit") < epoch(now))
    return jobs.filter(over & (seconds(F.col("submit_time")) >= epoch(since)) if since else over)


def running_resubmissions(jobs: DataFrame, now: datetime, since: datetime | None = None) -> DataFrame:
    """What became of :func:`old_running_jobs`: (what, n) with entries, distinct jobs, those never submitted again, and the latest states of the others."""
    hits = old_running_jobs(jobs, now, since).select("cluster_id", "job_id")
    known = jobs.filter(seconds(F.col("submit_time")) >= epoch(since)) if since else jobs
    story = known.join(hits.distinct(), ["cluster_id", "job_id"], "left_semi").groupBy("cluster_id", "job_id").agg(F.count("*").alias("n"), F.max_by("job_state", F.struct("submit_time", "job_db_id")).alias("latest"))
    what = F.when(F.col("n") == 1, F.lit("single")).otherwise(F.concat(F.lit("latest:"), F.col("latest")))
    out = hits.agg(F.lit("entries").alias("what"), F.count("*").alias("n")).unionByName(hits.distinct().agg(F.lit("jobs").alias("what"), F.count("*").alias("n")))
    return out.unionByName(story.groupBy(what.alias("what")).agg(F.count("*").alias("n")))


def duplicate_job_ids(jobs: DataFrame, lo: datetime, hi: datetime) -> DataFrame:
    """Job ids that several rows submitted in [lo, hi) hold, with the count per cluster, most common first."""
    s = seconds(F.col("submit_time"))
    per = jobs.filter((s >= epoch(lo)) & (s < epoch(hi))).groupBy("job_id", "cluster_id").agg(F.count("*").alias("n"))
    each = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "cluster_id", "n"))), lambda x: F.concat_ws(":", x["cluster_id"].cast("string"), x["n"].cast("string")))
    return per.groupBy("job_id").agg(F.sum("n").alias("n"), F.array_join(each, " ").alias("per_cluster")).filter("n > 1")


def gpu_share_per_node(jobs: DataFrame, lo: datetime, hi: datetime, gpu_type: str, threshold: float, min_seconds: float = 0, min_jobs: int = 1, exempt: Iterable[int] = ()) -> DataFrame:
    """Nodes where the share of GPU jobs on ``gpu_type`` is below ``threshold``; clusters in ``exempt`` need no minimum of jobs. A job counts on each of its nodes."""
    picked = jobs.filter((seconds(effective_start()) < epoch(hi)) & (seconds(effective_end()) > epoch(lo)) & (clipped_seconds(lo, hi) >= min_seconds) & (F.col("allocated_gres_gpu") > 0))
    hit = (F.col("harmonized_gpu_type") == gpu_type) | (F.col("allocated_gpu_type") == gpu_type)
    out = picked.select("cluster_id", F.explode("nodes").alias("node"), F.when(hit, 1).otherwise(0).alias("hit")).groupBy("cluster_id", "node").agg(F.sum("hit").alias("on_type"), F.count("*").alias("n_jobs"))
    out = out.withColumn("share", F.col("on_type") / F.col("n_jobs"))
    enough = F.col("n_jobs") >= min_jobs
    if exempt := list(exempt):
        enough |= F.col("cluster_id").isin(exempt)
    return out.filter((F.col("share") < threshold) & enough)


def low_gpu_users(jobs: DataFrame, stats: DataFrame, lo: datetime, hi: datetime, threshold: float, min_seconds: float = 0) -> DataFrame:
    """Logins whose average of median utilization x clipped seconds x GPUs is missing or below ``threshold``; a utilization over 1 is no value."""
    picked = jobs.filter((seconds(effective_start()) < epoch(hi)) & (seconds(effective_end()) > epoch(lo)) & (clipped_seconds(lo, hi) >= min_seconds) & (F.col("allocated_gres_gpu") > 0))
    util = stats.filter("name = 'gpu_utilization'").select(F.col("job_id").alias("job_db_id"), "median")
    both = picked.join(util, "job_db_id", "left")
    use = F.when(F.col("median") <= 1, F.col("median")) * clipped_seconds(lo, hi) * F.col("allocated_gres_gpu")
    return both.groupBy("cluster_user").agg(F.avg(use).alias("gpu_seconds")).filter(F.col("gpu_seconds").isNull() | (F.col("gpu_seconds") < threshold))


def _frames(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def scraping_volume(jobs: DataFrame, clusters: DataFrame, lo: datetime, hi: datetime, step_s: int, deviations: float) -> DataFrame:
    """Frames of clusters with fewer jobs than mean - k x deviation of that cluster's frames (never below 0), or with a threshold of 0."""
    n = int((epoch(hi) - epoch(lo)) // step_s)
    counted = frames_of(jobs, lo, hi, step_s).groupBy("cluster_id", "frame").agg(F.count("*").alias("n_jobs"))
    grid = _frames(clusters.select(F.col("id").alias("cluster_id")), n)
    dense = grid.join(counted, ["cluster_id", "frame"], "left").fillna(0, ["n_jobs"])
    own = Window.partitionBy("cluster_id")
    threshold = F.greatest(F.lit(0.0), F.avg("n_jobs").over(own) - deviations * F.coalesce(F.stddev_samp("n_jobs").over(own), F.lit(0.0)))
    return dense.withColumn("threshold", threshold).filter((F.col("n_jobs") < F.col("threshold")) | (F.col("threshold") == 0))


def statistics_coverage(jobs: DataFrame, stats: DataFrame, names: list[str], lo: datetime, hi: datetime, step_s: int, deviations: float, gpu: bool, by_node: Iterable[int] | bool = False, min_seconds: float = 0, min_jobs: int = 1) -> DataFrame:
    """Groups (frame, cluster, node or "(all)") where too small a share of jobs has a statistic.

    A job counts once per node, even in "(all)", and jobs without nodes not at all. A statistic's threshold is the mean minus ``deviations`` sample
    deviations of its shares over all groups, never below 0; a single group has threshold 0.
    """
    kind = F.col("allocated_gres_gpu") > 0 if gpu else F.col("allocated_gres_gpu") == 0
    picked = frames_of(jobs.filter(kind & (clipped_seconds(lo, hi) >= min_seconds)), lo, hi, step_s)
    nodes = picked.select("job_db_id", "cluster_id", "frame", F.explode("nodes").alias("node"))
    if by_node is True:
        group = F.col("node")
    else:
        chosen = [] if by_node is False else list(by_node)
        group = F.when(F.col("cluster_id").isin(chosen), F.col("node")).otherwise(F.lit("(all)")) if chosen else F.lit("(all)")
    has = stats.filter(F.col("name").isin(names)).groupBy(F.col("job_id").alias("job_db_id")).agg(*[F.bool_or(F.col("name") == n).alias(f"has_{n}") for n in names])
    counted = nodes.join(has, "job_db_id", "left").groupBy("frame", "cluster_id", group.alias("node")).agg(
        F.count("*").alias("n_jobs"), *[(F.sum(F.when(F.col(f"has_{n}"), 1).otherwise(0)) / F.count("*")).alias(n) for n in names])
    tall = counted.select("frame", "cluster_id", "node", "n_jobs", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("name", "share"))
    # a row per statistic
    bounds = tall.groupBy("name").agg(F.greatest(F.lit(0.0), F.avg("share") - deviations * F.stddev_samp("share")).alias("threshold"))
    return tall.join(F.broadcast(bounds), "name").filter((F.col("n_jobs") >= min_jobs) & (F.col("share") < F.coalesce("threshold", F.lit(0.0))))


def expected_missing(expected: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Expected names that the data lacks."""
    return expected.select(column).distinct().join(found.select(column).distinct(), column, "left_anti")


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).distinct().exceptAll(right.select(column).distinct())


def duplicate_users(users: DataFrame, column: str) -> DataFrame:
    """Non-empty emails or names that several users have, with the sorted ids."""
    return users.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
