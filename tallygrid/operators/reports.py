"""Reports over longer periods, and slicing of runs into frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.functions.timeaxis import DAY, HOUR, epoch, seconds

YEAR_S = 365.25 * DAY


def time_frames(jobs: DataFrame, columns: list[str] = (), start: datetime | None = None, end: datetime | None = None, size_s: int = 7 * DAY) -> DataFrame:
    """Runs sliced into frames of fixed size: start and end clipped, ``columns`` scaled by the part of the run, duration and timestamp (the frame's start) added.

    Frames begin at ``start`` (default: the first start) and go on while they begin at or before ``end`` (default: the last end); the last one is not cut.
    A run is in a frame if it starts before the frame ends and ends after it starts, so an open run drops out. The bounds are one row, joined lazily.
    """
    s, e = seconds(F.col("start_time")), seconds(F.col("end_time"))
    lo = F.lit(epoch(start)) if start else F.min(s)
    hi = F.lit(epoch(end)) if end else F.max(e)
    bounds = jobs.agg(F.max(lo).alias("__lo") if start else lo.alias("__lo"), F.max(hi).alias("__hi") if end else hi.alias("__hi")).withColumn("__one", F.lit(1))
    each = jobs.filter(s.isNotNull() & e.isNotNull()).withColumn("__s", s).withColumn("__e", e).withColumn("__one", F.lit(1)).join(F.broadcast(bounds), "__one")
    first = F.greatest(F.floor((F.col("__s") - F.col("__lo")) / size_s), F.lit(0))
    last = F.least(F.ceil((F.col("__e") - F.col("__lo")) / size_s) - 1, F.floor((F.col("__hi") - F.col("__lo")) / size_s))
    each = each.withColumn("__first", first).withColumn("__last", last).filter("__first <= __last").withColumn("__k", F.explode(F.sequence("__first", "__last")))
    a = F.col("__lo") + F.col("__k") * size_s
    each = each.withColumn("__a", a).filter((F.col("__s") < a + size_s) & (F.col("__e") > a))
    cs, ce = F.greatest("__s", "__a"), F.least(F.col("__e"), F.col("__a") + size_s)
    whole = F.col("__e") - F.col("__s")
    share = F.when(whole == 0, F.lit(float("nan"))).otherwise((ce - cs) / F.nullif(whole, F.lit(0.0)))
    changed = {"start_time": F.timestamp_micros((cs * 1e6).cast("long")), "end_time": F.timestamp_micros((ce * 1e6).cast("long")), **{c: F.col(c) * share for c in columns}}
    return each.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in jobs.columns], (ce - cs).alias("duration"), F.timestamp_micros((F.col("__a") * 1e6).cast("long")).alias("timestamp"))


def hours_by_category(jobs: DataFrame, lo: datetime, hi: datetime) -> DataFrame:
    """Shares of GPU hours inside a period by duration class, by size in GPU hours and by GPU count; the start is end - elapsed."""
    e = seconds(F.col("end_time"))
    s = e - F.col("elapsed_time")
    inside = F.greatest(F.least(e, F.lit(epoch(hi))) - F.greatest(s, F.lit(epoch(lo))), F.lit(0.0))
    x = jobs.filter((F.col("allocated_gres_gpu") > 0) & F.col("end_time").isNotNull()).select(
        (inside / HOUR * F.col("allocated_gres_gpu")).alias("h"), F.col("elapsed_time").alias("t"), F.col("allocated_gres_gpu").alias("g"), (F.col("elapsed_time") / HOUR * F.col("allocated_gres_gpu")).alias("gh")
    ).filter("h > 0")
    t, g, gh = F.col("t"), F.col("g"), F.col("gh")
    duration = F.when(t < HOUR, "< 1 h").when(t < DAY, "1-24 h").when(t < 28 * DAY, "1-28 d").otherwise(">= 28 d")
    count = F.when(g == 1, "1").when(g <= 4, "2-4").when(g <= 8, "5-8").when(g <= 32, "9-32").otherwise(">= 33")
    size = F.when(gh < 1, "< 1 GPU h").when(gh < 24, "1-24 GPU h").when(gh < 672, "24-672 GPU h").otherwise(">= 672 GPU h")
    kinds = F.explode(F.create_map(F.lit("duration"), duration, F.lit("gpus"), count, F.lit("size"), size)).alias("by", "category")
    sums = x.select("h", kinds).groupBy("by", "category").agg(F.sum("h").alias("gpu_hours"))
    return sums.withColumn("share", F.col("gpu_hours") / F.sum("gpu_hours").over(Window.partitionBy("by")))


def billed_by_cluster_and_gpus(jobs: DataFrame, cluster_ids: list[int]) -> DataFrame:
    """Billed years (elapsed x billing) by GPU count, a column per cluster."""
    wide = jobs.groupBy("allocated_gres_gpu").pivot("cluster_id", cluster_ids).agg(F.sum(F.col("elapsed_time") * F.col("allocated_billing") / YEAR_S))
    return wide.withColumnsRenamed({str(c): f"cluster_{c}" for c in cluster_ids})


def allocation_vs_usage(jobs: DataFrame, allocations: DataFrame) -> DataFrame:
    """Billed years per (cluster, month of start), projected to a year, running total, and the years allocated in that month.

    ``allocations``: cluster_id, start, end (dates, end excluded), years.
    """
    month = F.date_trunc("month", F.col("start_time")).cast("date")
    used = jobs.filter("start_time IS NOT NULL").groupBy("cluster_id", month.alias("month")).agg((F.sum(F.col("elapsed_time") * F.col("allocated_billing")) / YEAR_S).alias("billed"))
    running = F.sum("billed").over(Window.partitionBy("cluster_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    used = used.withColumn("projected", F.col("billed") * 12).withColumn("running", running)
    a = allocations.withColumnRenamed("cluster_id", "c")
    inside = (F.col("c") == F.col("cluster_id")) & (F.col("month") >= F.col("start")) & (F.col("month") < F.col("end"))
    return used.join(a, inside, "left").groupBy("cluster_id", "month", "billed", "projected", "running").agg(F.sum("years").alias("allocated"))


def waste_by_user(rows: DataFrame) -> DataFrame:
    """Used, wasted and overbilled seconds per user and their ratios, worst first.

    ``rows``: user, utilization (0 to 1), elapsed_time, requested, billing, gpus; jobs of at least 60 s; allocated is the larger of billing and GPUs.
    """
    x = rows.filter("elapsed_time >= 60 AND utilization IS NOT NULL").withColumn("allocated", F.greatest("billing", "gpus"))
    t, u = F.col("elapsed_time"), F.col("utilization")
    out = x.groupBy("user").agg(F.sum(u * t).alias("used"), F.sum((1 - u) * t).alias("wasted"), F.sum((F.col("allocated") - F.col("requested")) * t).alias("overbilled"))
    used = F.nullif(F.col("used"), F.lit(0.0))
    return out.withColumn("ratio", F.col("wasted") / used).withColumn("total_ratio", (F.col("wasted") + F.col("overbilled")) / used).orderBy(F.col("total_ratio").desc(), "user")


def tool_adoption(jobs: DataFrame, tool: str, every_week: bool = True) -> DataFrame:
    """Per week (Monday): users, users of jobs named ``tool``, both cumulative, and this week's users who have used it by now. A week without jobs between others is an error if ``every_week``."""
    week = F.date_trunc("week", F.col("submit_time")).cast("date").alias("week")
    x = jobs.select(week, F.col("cluster_user").alias("u"), (F.col("name") == tool).alias("hit")).groupBy("week", "u").agg(F.max("hit").alias("hit"))
    own = Window.partitionBy("u").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("first", F.min("week").over(Window.partitionBy("u"))).withColumn("by_now", F.max("hit").over(own))
    first_hit = F.min(F.when(F.col("hit"), F.col("week"))).over(Window.partitionBy("u"))
    x = x.withColumn("first_hit", first_hit)
    weekly = x.groupBy("week").agg(
        F.count("*").alias("users"), F.sum(F.col("hit").cast("int")).alias("tool_users"), F.sum((F.col("first") == F.col("week")).cast("int")).alias("new"),
        F.sum(F.coalesce((F.col("first_hit") == F.col("week")).cast("int"), F.lit(0))).alias("new_tool"), F.sum(F.col("by_now").cast("int")).alias("users_with_tool"))
    up = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)  # a row per week
    if every_week:
        gap = F.datediff("week", F.lag("week").over(Window.orderBy("week"))) > 7
        weekly = weekly.withColumn("users", F.when(gap, F.raise_error(F.concat(F.lit("no jobs in the week before "), F.col("week").cast("string"))).cast("long")).otherwise(F.col("users")))
    return weekly.select("week", "users", "tool_users", F.sum("new").over(up).alias("users_so_far"), F.sum("new_tool").over(up).alias("tool_users_so_far"), "users_with_tool")
