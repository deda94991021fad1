"""Metric samples of jobs and their statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Values from here on are sentinels of the collector, not measurements.
SENTINEL = 2.0**47
QUANTILES = (0.05, 0.25, 0.5, 0.75)
LABELS = ("instance", "core", "gpu")
#: Scale of each job metric: name in the statistics -> (sample metric, kind, factor).
JOB_METRICS = {
    "gpu_utilization": ("gpu_utilization", "gauge", 0.01), "gpu_utilization_fp16": ("fp16_active", "gauge", 0.01), "gpu_utilization_fp32": ("fp32_active", "gauge", 0.01),
    "gpu_utilization_fp64": ("fp64_active", "gauge", 0.01), "gpu_sm_occupancy": ("sm_occupancy", "gauge", 0.01), "gpu_memory": ("memory_usage", "gauge", 0.01),
    "gpu_power": ("power_usage", "gauge", 1.0), "cpu_utilization": ("core_usage_total", "counter", 1.0), "system_memory": ("memory_rss", "memory", 1 / 2**20),
}


def assign_to_runs(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples (cluster, job_id, ts_s, ...) given to runs (cluster, job_id, run_id, start_s, end_s) of the same job id.

    A lone run takes all samples of its id; where several share it, a sample goes to the runs with start <= ts <= end.
    """
    of_id = Window.partitionBy("cluster", "job_id")
    counted = runs.withColumn("n_runs", F.count("*").over(of_id))
    return samples.join(counted, ["cluster", "job_id"]).filter((F.col("n_runs") == 1) | F.col("ts_s").between(F.col("start_s"), F.col("end_s"))).drop("n_runs")


def summary(x: Column) -> list[Column]:
    """The seven numbers of a pool; quantiles interpolate linearly."""
    q = F.percentile(x, F.array(*map(F.lit, QUANTILES)))
    return [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(x).alias("max"), q.alias("q")]


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q25", "median", "q75"))], "max")


def metric_statistics(samples: DataFrame, keys: list[str], normalization: Callable[[Column], Column] | None = None) -> DataFrame:
    """Statistics of each key's pool of values; NaN and sentinels are no values (NaN is the largest number here); an empty pool gives no row."""
    x = F.col("value")
    pool = samples.filter(x < SENTINEL).withColumn("value", normalization(x) if normalization else x)
    return _flat(pool.groupBy(*keys).agg(*summary(F.col("value"))), keys)


def pool_statistics(samples: DataFrame, keys: list[str], normalization: Callable[[Column], Column] | None = None, ranges: int = 64) -> DataFrame:
    """:func:`metric_statistics` for few keys with pools of any size: quantiles come from counts of values in ``ranges`` sorted ranges per key, so no task holds a pool."""
    x = F.col("value")
    counts = samples.filter(x < SENTINEL).withColumn("value", normalization(x) if normalization else x).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    n, v = F.col("n"), F.col("value")
    cuts = F.percentile_approx("value", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 1000)
    whole = counts.groupBy(*keys).agg((F.sum(n * v) / F.sum("n")).alias("mean"), F.max("value").alias("max"), F.sum("n").alias("size"), cuts.alias("cuts"))
    each = counts.join(whole, keys).withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.col("value"))))
    up = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = each.groupBy(*keys, "range").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(up(keys, "range")), F.lit(0))).drop("m")
    ranked = each.join(base, [*keys, "range"]).withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(up([*keys, "range"], "value")), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + n), v))

    ends = [f((F.col("size") - 1) * q).alias(f"{name}{k}") for k, q in enumerate(QUANTILES) for name, f in (("lo", lambda p: at(F.floor(p))), ("hi", lambda p: at(F.ceil(p))))]
    spread = F.sqrt(F.sum(n * F.pow(v - F.col("mean"), 2)) / F.max("size"))
    found = ranked.groupBy(*keys, "mean", "max", "size").agg(spread.alias("std"), *ends)
    part = lambda q: (F.col("size") - 1) * q - F.floor((F.col("size") - 1) * q)
    q = F.array(*[F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * part(q) for k, q in enumerate(QUANTILES)])
    return _flat(found.withColumn("q", q), keys)


def counter_rates(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of nanosecond counters: differences of neighbours in input order within a source, per second and 1e9.

    A source is told by those of the labels instance, core and gpu that occur in the key's series; series without one of them are left out.
    """
    of_key = Window.partitionBy(*keys)
    each = samples.filter(F.col("value") < SENTINEL)
    for name in LABELS:
        each = each.withColumn(f"l_{name}", F.col("labels")[name])
        each = each.withColumn(f"u_{name}", F.max(F.col(f"l_{name}").isNotNull()).over(of_key))
    lacking = F.lit(False)
    for name in LABELS:
        lacking |= F.col(f"u_{name}") & F.col(f"l_{name}").isNull()
    order = Window.partitionBy(*keys, *[f"l_{n}" for n in LABELS]).orderBy("series_pos", "sample_pos")
    rate = (F.col("value") - F.lag("value").over(order)) / F.nullif(F.col("ts_s") - F.lag("ts_s").over(order), F.lit(0.0)) / 1e9
    return each.filter(~lacking).select(*keys, rate.alias("value")).filter("value IS NOT NULL")


def job_statistics(samples: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_db_id, name) statistics of the nine job metrics in one pass: percentages as shares, counters as rates, memory as a share of what the job holds.

    ``samples``: job_db_id, metric, labels, series_pos, sample_pos, ts_s, value; ``jobs``: job_db_id, allocated_mem (MB). Memory of jobs without allocated memory is skipped.
    """
    names = F.create_map(*[F.lit(x) for name, (metric, _, _) in JOB_METRICS.items() for x in (metric, name)])
    factors = F.create_map(*[F.lit(x) for name, (_, _, factor) in JOB_METRICS.items() for x in (name, factor)])
    named = samples.withColumn("name", names[F.col("metric")]).filter("name IS NOT NULL")
    counters = [n for n, (_, kind, _) in JOB_METRICS.items() if kind == "counter"]
    keys = ["job_db_id", "name"]
    gauges = named.filter(~F.col("name").isin(counters)).filter(F.col("value") < SENTINEL).select(*keys, "value")
    values = gauges.unionByName(counter_rates(named.filter(F.col("name").isin(counters)), keys))
    held = jobs.select("job_db_id", "allocated_mem")
    scaled = values.join(held, "job_db_id").withColumn("value", F.when(
        F.col("name") == "system_memory", F.col("value") * factors["system_memory"] / F.nullif(F.col("allocated_mem"), F.lit(0))).otherwise(F.col("value") * factors[F.col("name")]))
    return metric_statistics(scaled.filter("value IS NOT NULL"), keys)


def upsert_statistics(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("job_id", "name")) -> DataFrame:
    """Stored statistics with the recomputed ones in their place."""
    return stored.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def keep_latest(stats: DataFrame, keys: tuple[str, ...] = ("job_id", "name"), newest: str = "id") -> DataFrame:
    """Of rows that repeat a key, the one with the largest id."""
    w = Window.partitionBy(*keys).orderBy(F.col(newest).desc())
    return stats.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
