"""Registered queries over job series and dashboards, each with its SQL."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tallygrid.functions.timeaxis import Axis, parse_period
from tallygrid.operators import dashboard as d, jobseries as js
from tallygrid.plans import testdata as t
from tallygrid.plans.testdata import CLUSTERS_SQL, JOBS_SQL, STATS_SQL, USERS_SQL, WEIGHTS_SQL, with_sql

LO, HI = datetime(1998, 1, 7, 6), datetime(1998, 7, 2, 18)
LO_S, HI_S = int(LO.replace(tzinfo=UTC).timestamp()), int(HI.replace(tzinfo=UTC).timestamp())
WEEKS, MONTHS, TEN_DAYS = (Axis(LO, HI, parse_period(p)) for p in ("w", "m", "10d"))


def r4(df, *names):
    return df.select(*[F.round(c, 4).alias(c) if c in names else F.col(c) for c in df.columns])


def edges_sql(step: int, origin: int) -> str:
    """Buckets as rows (b, blo, bhi): fixed steps from an origin, clipped to the window."""
    return f"""
edges AS (
  SELECT b, greatest({origin} + b * {step}, {LO_S}) AS blo, least({origin} + (b + 1) * {step}, {HI_S}) AS bhi
  FROM (SELECT unnest(range({(LO_S - origin) // step}, {-(-(HI_S - origin) // step)})) AS b))"""


WEEK_EDGES = edges_sql(604800, 345600)
TEN_EDGES = edges_sql(864000, LO_S)
MONTH_EDGES = f"""
edges AS (
  SELECT row_number() OVER (ORDER BY m) AS b, greatest(CAST(epoch(m) AS BIGINT), {LO_S}) AS blo, least(CAST(epoch(m + INTERVAL 1 MONTH) AS BIGINT), {HI_S}) AS bhi
  FROM (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-07-01', INTERVAL 1 MONTH)) AS m))"""
SPANS = f"spans AS (SELECT *, start_s + elapsed_time AS stop_s FROM jobs WHERE elapsed_time > 0 AND start_s + elapsed_time > {LO_S} AND start_s < {HI_S})"
GPU = "gpu AS (SELECT s.*, w.rgu, w.drac_rgu FROM spans s LEFT JOIN weights w ON harmonized_gpu_type = w.name WHERE allocated_gres_gpu > 0 AND harmonized_gpu_type IS NOT NULL)"
CUT = "cut AS (SELECT gpu.*, b, blo, (least(stop_s, bhi) - greatest(start_s, blo)) / 3600.0::DOUBLE AS h FROM gpu JOIN edges ON start_s < bhi AND stop_s > blo)"
OCC = "occ AS (SELECT * FROM stats WHERE name = 'gpu_sm_occupancy')"
REAL = "(o.mean IS NOT NULL AND NOT isnan(o.mean))"


def _usage_sql(metric: str) -> str:
    means = ", ".join(f"max(mean) FILTER (WHERE name = '{n}' AND NOT isnan(mean)) AS {a}" for n, a in ((metric, "mean"), ("gpu_sm_occupancy", "occupancy"), ("gpu_utilization", "utilization")))
    return with_sql(JOBS_SQL, STATS_SQL, WEIGHTS_SQL, SPANS, GPU, WEEK_EDGES, CUT, f"m AS (SELECT job_id, {means} FROM stats GROUP BY 1)", body="""
SELECT e.blo AS bucket_s, round(coalesce(sum(x), 0) + 1e-6, 4) AS allocated, round(coalesce(sum(x * mean), 0) + 1e-6, 4) AS used, round(coalesce(sum(x) FILTER (WHERE mean IS NULL), 0) + 1e-6, 4) AS unmeasured,
       round(coalesce(sum(x * (0.5 - mean)) FILTER (WHERE mean < 0.5), 0) + 1e-6, 4) AS wasted, round(avg(occupancy), 4) AS gpu_sm_occupancy_mean, round(avg(utilization), 4) AS gpu_utilization_mean
FROM edges e LEFT JOIN (SELECT c.b, c.allocated_gres_gpu * c.rgu * c.h AS x, m.* FROM cut c LEFT JOIN m ON m.job_id = c.job_db_id) q ON q.b = e.b
GROUP BY e.blo""")



def _u(s, f):
    return t.jobs(s, f), t.statistics(s, f), t.weights(s)


def a1_running_per_week(s, f):
    return d.job_counts(t.jobs(s, f), WEEKS).drop("hi_s").withColumn("bucket_s", F.col("bucket_s").cast("long"))


def a1_running_per_month(s, f):
    return d.job_counts(t.jobs(s, f), MONTHS).withColumn("bucket_s", F.col("bucket_s").cast("long"))


def a1_submitted_per_ten_days(s, f):
    return d.job_counts(t.jobs(s, f), TEN_DAYS, submitted=True).withColumn("bucket_s", F.col("bucket_s").cast("long"))


def _usage(s, f, **how):
    """Sums are kept off rounding ties."""
    out = d.rgu_usage(*_u(s, f), WEEKS, minimum=0.5, **how)
    for c in ("allocated", "used", "unmeasured", "wasted"):
        out = out.withColumn(c, F.col(c) + 1e-6)
    out = out.withColumn("bucket_s", F.col("bucket_s").cast("long"))
    return r4(out, "allocated", "used", "unmeasured", "wasted", "gpu_sm_occupancy_mean", "gpu_utilization_mean")


def a2_rgu_usage_weekly(s, f):
    return _usage(s, f)


def a2_memory_use_weekly(s, f):
    """By another metric; the two trends stay beside it."""
    return _usage(s, f, metric="gpu_memory")


def a3_rgu_by_cluster(s, f):
    out = d.rgu_by_cluster(t.jobs(s, f), t.weights(s), WEEKS).withColumn("bucket_s", F.col("bucket_s").cast("long"))
    shift = [F.round(F.col(c) + 1e-6, 4).alias(c) for c in ("rgu_hours", "total")]  # keeps sums off rounding ties
    return out.select("bucket_s", "cluster_id", *shift)


def a4_rgu_by_user(s, f):
    return r4(d.rgu_by_user(*_u(s, f), LO, HI), "requested", "used", "unmeasured", "wasted")


def a5_metric_trend(s, f):
    out = d.metric_trend(t.jobs(s, f), t.statistics(s, f), MONTHS, "gpu_memory").withColumn("bucket_s", F.col("bucket_s").cast("long"))
    return r4(out, "avg_mean", "avg_max")


def a6_metric_distribution(s, f):
    return r4(d.metric_distribution(*_u(s, f), LO, HI, "gpu_sm_occupancy"), "rgu_seconds", "centre")


def a7_metric_comparison(s, f):
    return d.metric_comparison(t.jobs(s, f), t.statistics(s, f), LO, HI, "gpu_utilization", "gpu_memory")


def a8_time_vs_limit(s, f):
    return r4(d.time_vs_limit(t.jobs(s, f), LO, HI), "centre", "centre_limit")


L1_NUMBERS = ("elapsed_h", "elapsed_total", "rgu", "rgu_hours", "waste", "metric_mean", "gpu_utilization_mean", "gpu_sm_occupancy_mean", "gpu_memory_max")


def _page(s, f, **how):
    out = d.jobs_table(*_u(s, f), LO, HI, clusters=t.clusters(s, f), **how)
    out = out.withColumn("submit_s", F.unix_timestamp("submit_time")).withColumn("start_s", F.unix_timestamp("start_time")).drop("submit_time", "start_time")
    return r4(js_nan(out), *L1_NUMBERS)


def l1_jobs_table(s, f):
    return _page(s, f, limit=50, offset=25)


def l1_jobs_by_waste(s, f):
    return _page(s, f, sort="waste", metric="gpu_power")


def l1_jobs_by_memory(s, f):
    return _page(s, f, sort="gpu_memory_max", descending=False, limit=60)


def l1_jobs_by_cluster(s, f):
    return _page(s, f, sort="cluster", descending=False, limit=40, offset=7)


def l1_jobs_total(s, f):
    return d.jobs_total(t.jobs(s, f), LO, HI)


def js_nan(df):
    return df.select(*[js.nan_to(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def l2_keyset_page(s, f):
    return d.keyset_page(t.jobs(s, f), after=(3000, datetime(1999, 5, 1)), limit=100).select("job_db_id", F.unix_timestamp("submit_time").alias("submit_s"))


def j1_job_series(s, f):
    cols = ["job_db_id", "display_name", "email", "cluster_name", "domain", "allocated_rgu", "requested_rgu", "requested_drac_rgu", "cpu_cost", "cpu_waste", "cpu_overbilling", "gpu_cost", "gpu_waste", "gpu_overbilling", "gpu_memory_max"]
    out = js.job_series(t.jobs(s, f), t.statistics(s, f), t.weights(s), t.users(s, f), t.clusters(s, f), cols)
    return r4(js_nan(out), "allocated_rgu", "requested_rgu", "requested_drac_rgu", "cpu_cost", "cpu_waste", "cpu_overbilling", "gpu_cost", "gpu_waste", "gpu_overbilling", "gpu_memory_max")


def j2_statistic_inner(s, f):
    out = js.with_statistic(t.jobs(s, f), t.statistics(s, f), "cpu_utilization", ("mean", "max"), "inner")
    return r4(js_nan(out.select("job_db_id", "cpu_utilization_mean", "cpu_utilization_max")), "cpu_utilization_mean", "cpu_utilization_max")


def j20_nested_statistics(s, f):
    out = js.nested_statistics(t.jobs(s, f), t.statistics(s, f))
    own = F.col("statistics").getItem("gpu_memory")
    return out.select("job_db_id", F.size("statistics").cast("long").alias("n_stats"), F.array_join(F.array_sort(F.map_keys("statistics")), ",").alias("names"), F.round(own["q75"], 4).alias("q75"), F.when(own.isNotNull(), F.isnan(own["mean"])).alias("mean_missing"))


def j21_analysis_frame(s, f):
    out = js.analysis_frame(t.jobs(s, f), t.statistics(s, f), datetime(2002, 1, 1))
    return r4(js_nan(out.select("job_db_id", F.unix_timestamp("end_time").alias("end_s"), "gpu_utilization", "system_memory")), "gpu_utilization", "system_memory")


def f1_filter_jobs(s, f):
    out = js.filter_jobs(t.jobs(s, f), cluster="asia", state="RUNNING", start=LO, end=HI, clusters=t.clusters(s, f))
    return out.select("job_db_id", "cluster_user")


def f1_filter_by_email(s, f):
    return js.filter_jobs(t.jobs(s, f), email="p7@site.org", users=t.users(s, f)).select("job_db_id", "user_id")


def f2_count_jobs(s, f):
    return js.count_jobs(t.jobs(s, f), job_ids=[7, 8, 9, 4000], end=HI)


def f4_gpu_jobs(s, f):
    return js.gpu_jobs(t.jobs(s, f)).select("job_db_id", "harmonized_gpu_type")


def f5_ran_between(s, f):
    from tallygrid.functions.timeaxis import ran_between

    return t.jobs(s, f).filter(ran_between(LO, HI)).select("job_db_id")


def f6_common_filters(s, f):
    return js.common_filters(t.jobs(s, f), states=["COMPLETED", "CANCELLED"], cluster_ids=[1, 3], owner=5, known_clusters=range(5)).select("job_db_id")


def f7_valid_metric(s, f):
    return t.statistics(s, f).filter(js.valid_metric(F.col("mean"))).groupBy("name").agg(F.count("*").alias("n"))


def f10_selected_columns(s, f):
    out = js.job_series(t.jobs(s, f), t.statistics(s, f), t.weights(s), t.users(s, f), t.clusters(s, f), ["job_db_id", "cpu_cost"])
    return r4(out, "cpu_cost")


def l5_union_clusters(s, f):
    jobs = t.jobs(s, f)
    return js.union_clusters([jobs.filter(F.col("cluster_id") == c).select("job_db_id", F.lit(c).cast("long").alias("c")) for c in (0, 2)])


def l9_frame_diff(s, f):
    jobs = t.jobs(s, f).select("job_db_id", "nodes", "elapsed_time", "name")
    other = jobs.filter("job_db_id % 100 <> 3").withColumn("nodes", F.reverse("nodes")).withColumn("elapsed_time", F.when(F.col("job_db_id") % 50 == 7, F.col("elapsed_time") + 1).otherwise(F.col("elapsed_time")))
    return js.frame_diff(jobs, other, "job_db_id")


RUNNING = "SELECT blo AS bucket_s, bhi, count(s.job_db_id) AS n_jobs FROM edges LEFT JOIN spans s ON start_s < bhi AND stop_s > blo GROUP BY ALL"
TOTAL = "tot AS (SELECT cluster_id, sum(allocated_gres_gpu * rgu * h) AS total FROM cut GROUP BY 1 HAVING total > 0)"
PAGE = f"page AS (SELECT g.*, (least(stop_s, {HI_S}) - greatest(start_s, {LO_S})) / 3600.0::DOUBLE AS elapsed_h FROM gpu g)"


def _page_sql(order: str, metric: str, limit: int, offset: int) -> str:
    one = "LEFT JOIN stats {a} ON {a}.job_id = j.job_db_id AND {a}.name = '{n}'"
    stats = " ".join(one.format(a=a, n=n) for a, n in (("m", metric), ("u", "gpu_utilization"), ("o", "gpu_sm_occupancy"), ("y", "gpu_memory")))
    real = lambda x, other="NULL": f"CASE WHEN isnan({x}) THEN {other} ELSE {x} END"
    return with_sql(JOBS_SQL, STATS_SQL, WEIGHTS_SQL, CLUSTERS_SQL, SPANS, GPU, PAGE, body=f"""
SELECT job_db_id, cluster_name, job_id, submit_s, start_s, cluster_user, job_state, round(elapsed_h, 4) AS elapsed_h, round(elapsed_time, 4) AS elapsed_total, array_to_string(nodes, ', ') AS nodes, requested_gres_gpu, allocated_gres_gpu, allocated_billing,
       gpu_type, gpu_type_rgu, round(rgu, 4) AS rgu, round(rgu_hours, 4) AS rgu_hours, round(rgu_hours * (1 - {real('mm')}), 4) AS waste, round({real('mm')}, 4) AS metric_mean,
       round({real('um', '-1')}, 4) AS gpu_utilization_mean, round({real('om', '-1')}, 4) AS gpu_sm_occupancy_mean, round({real('ym')}, 4) AS gpu_memory_max
FROM (SELECT j.job_db_id, c.name AS cluster_name, j.job_id, submit_s, start_s, cluster_user, job_state, elapsed_h, elapsed_time, nodes, requested_gres_gpu, allocated_gres_gpu, allocated_billing, harmonized_gpu_type AS gpu_type, rgu AS gpu_type_rgu,
             allocated_gres_gpu * rgu AS rgu, allocated_gres_gpu * rgu * elapsed_h AS rgu_hours, m.mean AS mm, u.mean AS um, o.mean AS om, y.max AS ym,
             CASE WHEN isnan(m.mean) THEN 'inf'::DOUBLE ELSE allocated_gres_gpu * rgu * elapsed_h * (1 - m.mean) END AS by_waste, y.max AS by_memory
      FROM page j JOIN clusters c ON c.id = j.cluster_id {stats})
ORDER BY {order}, job_db_id LIMIT {limit} OFFSET {offset}""")


SQL = {
    "a1_running_per_week": with_sql(JOBS_SQL, SPANS, WEEK_EDGES, body="SELECT bucket_s, n_jobs FROM (" + RUNNING + ")"),
    "a1_running_per_month": with_sql(JOBS_SQL, SPANS, MONTH_EDGES, body="SELECT bucket_s, n_jobs FROM (" + RUNNING + ")"),
    "a1_submitted_per_ten_days": with_sql(JOBS_SQL, TEN_EDGES, body="SELECT blo AS bucket_s, count(j.job_db_id) AS n_jobs FROM edges LEFT JOIN jobs j ON submit_s >= blo AND submit_s < bhi GROUP BY ALL"),
    "a2_rgu_usage_weekly": _usage_sql("gpu_sm_occupancy"),
    "a2_memory_use_weekly": _usage_sql("gpu_memory"),
    "a3_rgu_by_cluster": with_sql(JOBS_SQL, WEIGHTS_SQL, SPANS, GPU, WEEK_EDGES, CUT, TOTAL, body="""
SELECT e.blo AS bucket_s, t.cluster_id, round(coalesce(sum(c.allocated_gres_gpu * c.rgu * c.h), 0) + 1e-6, 4) AS rgu_hours, round(any_value(t.total) + 1e-6, 4) AS total
FROM edges e CROSS JOIN tot t LEFT JOIN cut c ON c.b = e.b AND c.cluster_id = t.cluster_id GROUP BY ALL"""),
    "a4_rgu_by_user": with_sql(JOBS_SQL, STATS_SQL, WEIGHTS_SQL, SPANS, GPU, OCC, PAGE, body=f"""
SELECT coalesce(cluster_user, 'unknown') AS login, round(sum(x), 4) AS requested, round(coalesce(sum(x * mean) FILTER (WHERE ok), 0), 4) AS used, round(coalesce(sum(x) FILTER (WHERE NOT ok), 0), 4) AS unmeasured, round(coalesce(sum(x * (0.15 - mean)) FILTER (WHERE ok AND mean < 0.15), 0), 4) AS wasted, count(*) AS n_jobs
FROM (SELECT p.cluster_user, p.allocated_gres_gpu * p.rgu * p.elapsed_h AS x, o.mean, coalesce({REAL}, false) AS ok FROM page p LEFT JOIN occ o ON o.job_id = p.job_db_id) GROUP BY 1"""),
    "a5_metric_trend": with_sql(JOBS_SQL, STATS_SQL, WEIGHTS_SQL, SPANS, GPU, MONTH_EDGES, CUT, body="""
SELECT e.blo AS bucket_s, round(avg(q.mean) FILTER (WHERE NOT isnan(q.mean)), 4) AS avg_mean, round(avg(q.max), 4) AS avg_max
FROM edges e LEFT JOIN (SELECT c.b, m.mean, m.max FROM cut c JOIN stats m ON m.job_id = c.job_db_id AND m.name = 'gpu_memory') q ON q.b = e.b GROUP BY 1"""),
    "a6_metric_distribution": with_sql(JOBS_SQL, STATS_SQL, WEIGHTS_SQL, SPANS, GPU, OCC, PAGE, body=f"""
SELECT CAST(least(greatest(floor(o.mean * 50), 0), 49) AS INTEGER) AS bin, round(sum(p.allocated_gres_gpu * p.rgu * p.elapsed_h * 3600), 4) AS rgu_seconds, round((bin + 0.5) / 50, 4) AS centre
FROM page p JOIN occ o ON o.job_id = p.job_db_id WHERE {REAL} AND o.mean >= 0 GROUP BY bin"""),
    "a7_metric_comparison": with_sql(JOBS_SQL, STATS_SQL, WEIGHTS_SQL, SPANS, GPU, body="""
SELECT CAST(least(greatest(floor(a.mean * 100), 0), 99) AS INTEGER) AS bin_a, CAST(least(greatest(floor(b.mean * 100), 0), 99) AS INTEGER) AS bin_b, count(*) AS n_jobs
FROM gpu g JOIN stats a ON a.job_id = g.job_db_id AND a.name = 'gpu_utilization' JOIN stats b ON b.job_id = g.job_db_id AND b.name = 'gpu_memory'
WHERE a.mean IS NOT NULL AND NOT isnan(a.mean) AND b.mean IS NOT NULL AND NOT isnan(b.mean) GROUP BY ALL"""),
    "a8_time_vs_limit": with_sql(JOBS_SQL, body=f"""
, p AS (SELECT elapsed_time AS elapsed, CAST(start_s - submit_s AS DOUBLE) AS wait, CAST(time_limit AS DOUBLE) AS lim FROM jobs WHERE submit_s >= {LO_S} AND submit_s < {HI_S} AND time_limit IS NOT NULL AND start_s IS NOT NULL),
m AS (SELECT greatest(max(elapsed), 1e-9) AS te, greatest(max(wait), 1e-9) AS tw, greatest(max(lim), 1e-9) AS tl FROM p),
k AS (SELECT 'elapsed' AS kind, elapsed AS v, te AS tv, lim, tl FROM p, m UNION ALL SELECT 'wait', wait, tw, lim, tl FROM p, m)
SELECT kind, CAST(least(greatest(floor(log10(v + 1) * 100 / log10(tv + 1)), 0), 99) AS INTEGER) AS bin, CAST(least(greatest(floor(log10(lim + 1) * 100 / log10(tl + 1)), 0), 99) AS INTEGER) AS bin_limit,
       round(power(10, (least(greatest(floor(log10(v + 1) * 100 / log10(tv + 1)), 0), 99) + 0.5) * log10(tv + 1) / 100) - 1, 4) AS centre,
       round(power(10, (least(greatest(floor(log10(lim + 1) * 100 / log10(tl + 1)), 0), 99) + 0.5) * log10(tl + 1) / 100) - 1, 4) AS centre_limit, count(*) AS n_jobs FROM k GROUP BY ALL"""),
    "l1_jobs_table": _page_sql("rgu_hours DESC NULLS LAST", "gpu_sm_occupancy", 50, 25),
    "l1_jobs_by_waste": _page_sql("by_waste DESC NULLS LAST", "gpu_power", 50, 0),
    "l1_jobs_by_memory": _page_sql("by_memory ASC NULLS LAST", "gpu_sm_occupancy", 60, 0),
    "l1_jobs_by_cluster": _page_sql("cluster_name ASC", "gpu_sm_occupancy", 40, 7),
    "l1_jobs_total": with_sql(JOBS_SQL, SPANS, body="SELECT count(*) AS total FROM spans WHERE allocated_gres_gpu > 0 AND harmonized_gpu_type IS NOT NULL"),
    "l2_keyset_page": with_sql(JOBS_SQL, body="SELECT job_db_id, submit_s FROM jobs WHERE submit_s < 925516800 OR (submit_s = 925516800 AND job_db_id > 3000) ORDER BY submit_s DESC, job_db_id LIMIT 100"),
    "j1_job_series": with_sql(JOBS_SQL, STATS_SQL, WEIGHTS_SQL, USERS_SQL, CLUSTERS_SQL, body="""
SELECT j.job_db_id, u.display_name, u.email, c.name AS cluster_name, c.domain, round(coalesce(allocated_gres_gpu, 0) * w.rgu, 4) AS allocated_rgu, round(coalesce(requested_gres_gpu, 0) * w.rgu, 4) AS requested_rgu,
       round(coalesce(requested_gres_gpu, 0) * w.drac_rgu, 4) AS requested_drac_rgu, round(elapsed_time * allocated_cpu, 4) AS cpu_cost,
       round(CASE WHEN isnan(k.mean) THEN NULL ELSE (1 - k.mean) * elapsed_time * allocated_cpu END, 4) AS cpu_waste, round(elapsed_time * (allocated_cpu - requested_cpu), 4) + 0.0 AS cpu_overbilling,
       round(elapsed_time * allocated_gres_gpu * w.drac_rgu, 4) AS gpu_cost, round(CASE WHEN isnan(o.mean) THEN NULL ELSE (1 - o.mean) * (elapsed_time * allocated_gres_gpu * w.drac_rgu) END, 4) AS gpu_waste,
       round(elapsed_time * w.drac_rgu * (allocated_gres_gpu - requested_gres_gpu), 4) + 0.0 AS gpu_overbilling, round(m.max, 4) AS gpu_memory_max
FROM jobs j LEFT JOIN users u ON u.id = j.user_id LEFT JOIN clusters c ON c.id = j.cluster_id LEFT JOIN weights w ON w.name = j.harmonized_gpu_type
LEFT JOIN stats k ON k.job_id = j.job_db_id AND k.name = 'cpu_utilization' LEFT JOIN stats o ON o.job_id = j.job_db_id AND o.name = 'gpu_sm_occupancy' LEFT JOIN stats m ON m.job_id = j.job_db_id AND m.name = 'gpu_memory'"""),
    "j2_statistic_inner": with_sql(JOBS_SQL, STATS_SQL, body="SELECT job_db_id, round(CASE WHEN isnan(mean) THEN NULL ELSE mean END, 4) AS cpu_utilization_mean, round(max, 4) AS cpu_utilization_max FROM jobs JOIN stats s ON s.job_id = job_db_id AND s.name = 'cpu_utilization'"),
    "j20_nested_statistics": with_sql(JOBS_SQL, STATS_SQL, body="""
SELECT job_db_id, count(s.name) AS n_stats, coalesce(string_agg(s.name, ',' ORDER BY s.name), '') AS names, round(max(q75) FILTER (WHERE s.name = 'gpu_memory'), 4) AS q75,
       bool_or(mean IS NULL OR isnan(mean)) FILTER (WHERE s.name = 'gpu_memory') AS mean_missing
FROM jobs LEFT JOIN stats s ON s.job_id = job_db_id GROUP BY job_db_id"""),
    "j21_analysis_frame": with_sql(JOBS_SQL, STATS_SQL, body="""
SELECT job_db_id, coalesce(end_s, 1009843200) AS end_s, round(CASE WHEN u.median > 1 THEN NULL ELSE u.median END, 4) AS gpu_utilization, round(m.max, 4) AS system_memory
FROM jobs LEFT JOIN stats u ON u.job_id = job_db_id AND u.name = 'gpu_utilization' LEFT JOIN stats m ON m.job_id = job_db_id AND m.name = 'system_memory'"""),
    "f1_filter_jobs": with_sql(JOBS_SQL, CLUSTERS_SQL, body=f"SELECT job_db_id, cluster_user FROM jobs WHERE cluster_id IN (SELECT id FROM clusters WHERE name = 'asia') AND job_state = 'RUNNING' AND submit_s < {HI_S} AND (end_s IS NULL OR end_s > {LO_S})"),
    "f1_filter_by_email": with_sql(JOBS_SQL, USERS_SQL, body="SELECT job_db_id, user_id FROM jobs WHERE user_id IN (SELECT id FROM users WHERE email = 'p7@site.org')"),
    "f2_count_jobs": with_sql(JOBS_SQL, body=f"SELECT count(*) AS n FROM jobs WHERE job_id IN (7, 8, 9, 4000) AND submit_s < {HI_S}"),
    "f4_gpu_jobs": with_sql(JOBS_SQL, body="SELECT job_db_id, harmonized_gpu_type FROM jobs WHERE allocated_gres_gpu > 0 AND harmonized_gpu_type IS NOT NULL"),
    "f5_ran_between": with_sql(JOBS_SQL, SPANS, body="SELECT job_db_id FROM spans"),
    "f6_common_filters": with_sql(JOBS_SQL, body="SELECT job_db_id FROM jobs WHERE job_state IN ('COMPLETED', 'CANCELLED') AND cluster_id IN (1, 3) AND user_id = 5"),
    "f7_valid_metric": with_sql(STATS_SQL, body="SELECT name, count(*) AS n FROM stats WHERE mean IS NOT NULL AND NOT isnan(mean) AND mean >= 0 GROUP BY 1"),
    "f10_selected_columns": with_sql(JOBS_SQL, body="SELECT job_db_id, round(elapsed_time * allocated_cpu, 4) AS cpu_cost FROM jobs"),
    "l5_union_clusters": with_sql(JOBS_SQL, body="SELECT job_db_id, cluster_id AS c FROM jobs WHERE cluster_id IN (0, 2)"),
    "l9_frame_diff": with_sql(JOBS_SQL, body="SELECT job_db_id, CASE WHEN job_db_id % 100 = 3 THEN 'left only' ELSE 'elapsed_time' END AS difference, job_db_id % 100 <> 3 AS in_both FROM jobs WHERE job_db_id % 100 = 3 OR job_db_id % 50 = 7"),
}
SQL["a8_time_vs_limit"] = SQL["a8_time_vs_limit"].replace("FROM spans_of)\n, p AS", "FROM spans_of),\np AS")

QUERIES = {name: globals()[name] for name in SQL}
