"""Registered queries over samples and underuse, each with its SQL where there is any."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tallygrid.functions.folders import shared_folder
from tallygrid.functions.timeaxis import cycle_ends
from tallygrid.operators import samples as sm, underuse as uu
from tallygrid.plans import testdata as t
from tallygrid.plans.testdata import JOBS_SQL, SAMPLES_SQL, STATS_SQL, WEIGHTS_SQL, with_sql

START, END = datetime(1997, 1, 1), datetime(1999, 1, 1)
START_S, END_S = 852076800, 915148800
WEEKS, CYCLES, TRAILING, RUN = 8, 4, 2, 2
ANCHOR = cycle_ends(date(1998, 12, 1), WEEKS, 1)[0]
ANCHOR_S = (ANCHOR - date(1970, 1, 1)).days * 86400
RATIO, HOURS, ACTION, CEILING = 0.3, 50.0, 400.0, 0.9


def r3(df, *names):
    """Rounded off ties."""
    return df.select(*[F.round(F.col(c) + 1e-6, 3).alias(c) if c in names else F.col(c) for c in df.columns])


def _rows(s, f, **window):
    return uu.usage_rows(t.jobs(s, f), t.statistics(s, f), t.weights(s), **window)


def _classified(s, f):
    return uu.classify_cycles(_rows(s, f), ANCHOR, WEEKS, CYCLES, TRAILING, RATIO, HOURS, ACTION, CEILING)


def a9_metric_statistics(s, f):
    return r3(sm.metric_statistics(t.samples(s, f), ["job_id", "metric"]), "mean", "std", "q05", "q25", "median", "q75", "max")


def a9_normalized_statistics(s, f):
    return r3(sm.pool_statistics(t.samples(s, f), ["metric"], lambda x: x / 100), "mean", "std", "q05", "q25", "median", "q75", "max")


def a10_counter_rates(s, f):
    rates = sm.counter_rates(t.samples(s, f), ["job_id", "metric"]).withColumn("value", F.col("value") * 1e12)
    return r3(rates.groupBy("job_id", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max")), "mean", "max")


def job_samples(s, f):
    """(samples, jobs) of the nine job metrics, made from the events."""
    names = F.create_map(*[F.lit(x) for x in ("click", "sm_occupancy", "view", "memory_rss", "purchase", "core_usage_total", "error", "power_usage", "signup", "memory_usage", "login", "gpu_utilization")])
    x = t.samples(s, f).withColumn("metric", F.coalesce(names[F.col("metric")], F.lit("other")))
    scaled = F.when(F.col("metric") == "core_usage_total", F.col("value") * 1e10).when(F.col("metric") == "memory_rss", F.col("value") * 2**20).otherwise(F.col("value"))
    x = x.withColumn("value", scaled).withColumnRenamed("job_id", "job_db_id")
    jobs = x.select("job_db_id").distinct().withColumn("allocated_mem", F.when(F.col("job_db_id") % 10 == 3, F.lit(0)).otherwise(F.col("job_db_id") + 1))
    return x, jobs


def a11_job_statistics(s, f):
    return r3(sm.job_statistics(*job_samples(s, f)), "mean", "std", "q05", "q25", "median", "q75", "max")


def j17_samples_to_runs(s, f):
    x = t.samples(s, f).withColumn("cluster", F.lit("c"))
    cut = 1705276800.0
    ids = x.select("cluster", "job_id").distinct()
    one = ids.select("*", F.col("job_id").alias("run_id"), F.lit(0.0).alias("start_s"), F.lit(cut).alias("end_s"))
    two = ids.filter("job_id % 3 = 0").select("cluster", "job_id", (F.col("job_id") + 100000).alias("run_id"), F.lit(cut + 3600).alias("start_s"), F.lit(cut + 864000).alias("end_s"))
    return sm.assign_to_runs(x, one.unionByName(two)).select("run_id", "metric", "sample_pos")


def s11_upsert_statistics(s, f):
    stats = t.statistics(s, f).select("job_id", "name", "max")
    fresh = stats.filter("job_id % 5 = 0").withColumn("max", F.lit(2.0)).unionByName(s.range(3).select(F.col("id").alias("job_id"), F.lit("new").alias("name"), F.lit(3.0).alias("max")))
    return sm.upsert_statistics(stats, fresh).select("job_id", "name", F.round("max", 6).alias("max"))


def s15_keep_latest(s, f):
    rows = t.table(s, f, "lineitem").selectExpr("l_orderkey AS job_id", "concat('m', l_linenumber) AS name", "l_partkey * 100000 + l_suppkey AS id")
    return sm.keep_latest(rows)


def f8_usage_window(s, f):
    return r3(_rows(s, f, start=START, end=END, cluster_ids=[0, 1, 2]).select("job_db_id", "cost", "waste"), "cost", "waste")


def f9_email_selector(s, f):
    keep = uu.email_selector(["~p7@site.org", "~p8@site.org"])
    return t.users(s, f).filter(keep).select("id", "email")


def a18_user_usage(s, f):
    return r3(uu.user_usage(_rows(s, f, start=START, end=END), CEILING), "rgu_hours", "true_used", "used", "wasted", "user_rgu_hours", "user_used", "user_wasted", "user_ratio")


def a22_active_users(s, f):
    return r3(uu.active_users(_rows(s, f, start=START, end=END), 2000.0).select("user_id", "cluster_id", "rgu_hours"), "rgu_hours")


def a23_underusers(s, f):
    return r3(uu.underusers(_rows(s, f, start=START, end=END), 0.45, 500.0, CEILING).select("user_id", "cluster_id", "wasted"), "wasted")


def a19_classify_cycles(s, f):
    return r3(_classified(s, f), "rgu_hours", "wasted", "sm_occ_mean")


def a20_escalation_flags(s, f):
    return uu.escalated(_classified(s, f), CYCLES, RUN)


def w7_cycle_markers(s, f):
    return uu.cycle_markers(uu.escalated(_classified(s, f), CYCLES, RUN), future=1).groupBy("cycle", "marker").agg(F.count("*").alias("n"))


def s13_refresh_periods(s, f):
    fresh = uu.period_rows(_classified(s, f), ANCHOR, WEEKS, CYCLES, RUN)
    old = fresh.filter("user_id % 2 = 0").withColumn("rgu_hours", F.lit(-1.0)).unionByName(fresh.filter("user_id % 3 = 0").withColumn("end_date", F.date_sub("end_date", 7000)))
    out = uu.refresh_periods(old.dropDuplicates(["user_id", "cluster_id", "end_date"]), fresh, range(4), date(1998, 1, 1))
    return r3(out.select("user_id", "cluster_id", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "rgu_hours", "elevated"), "rgu_hours")


def a21_recurring_underusers(s, f):
    """The newest of the displayed cycles has no data yet, so its flags are null."""
    return r3(uu.recurring_underusers(_classified(s, f), TRAILING, CYCLES, RUN, future=1), "wasted", "true_wasted", "cluster_share")


def a21_from_periods(s, f):
    stored = uu.period_rows(_classified(s, f), ANCHOR, WEEKS, CYCLES, RUN)
    out = uu.recurring_from_periods(stored, ANCHOR + timedelta(weeks=WEEKS), WEEKS, CYCLES, TRAILING)
    return r3(out, "wasted", "cluster_share")


def c20_units(s, f):
    use = uu.user_usage(_rows(s, f, start=START, end=END), CEILING).filter("user_id IS NOT NULL")
    hours = F.round(F.col("rgu_hours") * 10, 3) + 0.001  # off rounding ties
    return use.select("user_id", "cluster_id", uu.in_units(hours).alias("weeks"), uu.in_whole_units(hours * 1000).alias("whole"), uu.in_units(hours, uu.MODEL_WEEK).alias("model_weeks"), uu.percent(F.round("user_ratio", 5) + 1e-7).alias("ratio"))


def w3_cumulative_share_cut(s, f):
    return r3(uu.cumulative_share_cut(uu.recurring_underusers(_classified(s, f), TRAILING, CYCLES, RUN), 0.5).select("cluster_id", "user_id", "wasted"), "wasted")


def w2_top_and_bottom_jobs(s, f):
    return uu.top_and_bottom_jobs(_rows(s, f, start=START, end=END), 2).select("user_id", "job_db_id", "list", "rank")


def l3_digest_top(s, f):
    return r3(uu.digest_top(uu.user_usage(_rows(s, f, start=START, end=END), CEILING), 10), "wasted")


def l4_listing_by_cluster(s, f):
    jobs = uu.top_and_bottom_jobs(_rows(s, f, start=START, end=END), 3).filter("list = 'worst'")
    return r3(uu.listing_by_cluster(jobs).select("user_id", "cluster_id", "job_db_id", "cluster_rank", "cluster_sum"), "cluster_sum")


def l7_recipients(s, f):
    rows = _rows(s, f, start=START, end=END)
    return uu.recipients(uu.active_users(rows, 100.0), uu.underusers(rows, 0.45, 500.0, CEILING))


def l8_report_due(s, f):
    days = t.table(s, f, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.filter(uu.report_due(F.col("d"), 4, 1)).select(F.date_format("d", "yyyy-MM-dd").alias("d"))


def s14_recurring_table(s, f):
    """From the stored periods, with the cycle ahead of them displayed too; written as CSV and read back."""
    periods = uu.period_rows(_classified(s, f), ANCHOR, WEEKS, CYCLES, RUN)
    rows = uu.recurring_from_periods(periods, ANCHOR + timedelta(weeks=WEEKS), WEEKS, CYCLES, TRAILING)
    out = uu.recurring_table(rows, CYCLES, TRAILING, "https://usage.invalid/jobs")
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    uu.export_recurring(out, path)
    return s.read.schema(out.schema).option("header", True).csv(path).fillna("")


def _usage_sql(where: str = f"end_s >= {START_S} AND end_s < {END_S}") -> str:
    return f"""
rows_of AS (
  SELECT *, (1 - occ_mean) * cost AS waste FROM (
    SELECT j.*, o.mean AS occ_mean, elapsed_time * allocated_gres_gpu * w.drac_rgu AS cost
    FROM jobs j JOIN weights w ON w.name = harmonized_gpu_type JOIN stats o ON o.job_id = job_db_id AND o.name = 'gpu_sm_occupancy'
    WHERE allocated_gpu_type IS NOT NULL AND end_s IS NOT NULL AND {where} AND o.mean IS NOT NULL AND NOT isnan(o.mean)) WHERE cost IS NOT NULL)"""


USE = """
per AS (
  SELECT user_id, cluster_id, sum(cost / 3600) AS rgu_hours, sum(cost / 3600 - waste / 3600) AS true_used, sum(cost / 3600 - greatest(0.0, waste - cost * (1 - {ceiling})) / 3600) AS used
  FROM rows_of GROUP BY ALL),
usage_of AS (
  SELECT *, rgu_hours - used AS wasted, sum(rgu_hours) OVER u AS user_rgu_hours, sum(used) OVER u AS user_used, sum(rgu_hours - used) OVER u AS user_wasted,
         CASE WHEN sum(rgu_hours) OVER u > 0 THEN sum(rgu_hours - used) OVER u / sum(rgu_hours) OVER u ELSE 0 END AS user_ratio FROM per WINDOW u AS (PARTITION BY user_id))"""
STEP = WEEKS * 7 * 86400
CLASSIFIED = f"""
cyc AS (SELECT *, CAST(floor(({ANCHOR_S} - end_s - 1e-6) / {STEP}) AS INTEGER) AS cycle FROM rows_of WHERE end_s < {ANCHOR_S} AND end_s >= {ANCHOR_S - STEP * (CYCLES + TRAILING - 1)}),
cper AS (SELECT cycle, user_id, cluster_id, sum(cost / 3600) AS rgu_hours, sum(cost / 3600 - waste / 3600) AS true_used, sum(greatest(0.0, waste - cost * (1 - {CEILING})) / 3600) AS wasted FROM cyc GROUP BY ALL),
cuser AS (SELECT cycle, user_id, sum(rgu_hours) AS h, sum(wasted) AS w FROM cper GROUP BY ALL),
ctrail AS (SELECT a.cycle, a.user_id, sum(b.w) AS tw FROM cuser a JOIN cuser b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.cycle BETWEEN a.cycle AND a.cycle + {TRAILING - 1} GROUP BY ALL),
cls AS (
  SELECT p.cycle, p.user_id, p.cluster_id, p.rgu_hours, p.wasted, CASE WHEN p.rgu_hours > 0 THEN p.true_used / p.rgu_hours ELSE 1.0 END AS sm_occ_mean,
         u.h > 0 AND u.w / nullif(u.h, 0) >= {RATIO} AND u.w >= {HOURS} AS isunderuser, u.h > 0 AND u.w / nullif(u.h, 0) >= {RATIO} AND u.w >= {HOURS} AND x.tw >= {ACTION} AS flagged
  FROM cper p JOIN cuser u ON u.cycle = p.cycle AND u.user_id IS NOT DISTINCT FROM p.user_id JOIN ctrail x ON x.cycle = p.cycle AND x.user_id IS NOT DISTINCT FROM p.user_id
  WHERE p.cycle < {CYCLES} AND p.user_id IS NOT NULL),
grid AS (SELECT user_id, cycle FROM (SELECT DISTINCT user_id FROM cls) CROSS JOIN (SELECT unnest(range({CYCLES})) AS cycle)),
flg AS (SELECT g.user_id, CAST(g.cycle AS INTEGER) AS cycle, coalesce(bool_or(flagged), false) AS flagged, coalesce(bool_or(isunderuser), false) AS isunderuser FROM grid g LEFT JOIN cls c ON c.user_id = g.user_id AND c.cycle = g.cycle GROUP BY ALL),
esc AS (SELECT *, sum(CAST(flagged AS INTEGER)) OVER (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) = {RUN} AS elevated FROM flg)"""
FLAGS = (("c", "isunderuser"), ("f", "flagged"), ("e", "elevated"))
REC = f"""
rec0 AS (SELECT cluster_id, user_id, sum(wasted) AS wasted, sum(rgu_hours * (1 - sm_occ_mean)) AS true_wasted FROM cls WHERE cycle < {TRAILING} GROUP BY ALL HAVING sum(wasted) > 0),
wide AS (SELECT user_id, {', '.join(f'bool_or({c}) FILTER (WHERE cycle = {i} AND cycle >= 1) AS {n}{i}' for n, c in FLAGS for i in range(CYCLES))} FROM esc GROUP BY 1),
rec AS (SELECT r.user_id, r.cluster_id, r.wasted, r.true_wasted, {', '.join(f'{n}{i}' for n, _ in FLAGS for i in range(CYCLES))}, r.wasted / sum(r.wasted) OVER (PARTITION BY r.cluster_id) AS cluster_share FROM rec0 r JOIN wide USING (user_id))"""
#: The stored cycles seen a cycle later: the newest displayed one has no data yet.
AHEAD = f"""
sh AS (
  SELECT c.user_id, c.cluster_id, c.wasted, c.isunderuser, c.flagged, c.cycle + 1 AS cycle, e.elevated
  FROM cls c JOIN esc e ON e.user_id = c.user_id AND e.cycle = c.cycle WHERE c.cycle + 1 < {CYCLES}),
win AS (SELECT cluster_id, user_id, sum(wasted) AS wasted FROM sh WHERE cycle < {TRAILING} GROUP BY ALL HAVING sum(wasted) > 0),
fl AS (SELECT user_id, {', '.join(f"coalesce(bool_or({c}) FILTER (WHERE cycle = {i}), false) AS {n}{i}" for n, c in FLAGS for i in range(CYCLES))} FROM sh GROUP BY 1),
ahead AS (
  SELECT cluster_id, user_id, wasted, wasted / sum(wasted) OVER (PARTITION BY cluster_id) AS share,
         {', '.join(f"CASE WHEN (SELECT min(cycle) FROM sh) <= {i} THEN {n}{i} END AS {n}{i}" for n, _ in FLAGS for i in range(CYCLES))} FROM win JOIN fl USING (user_id))"""
BASE = (JOBS_SQL, STATS_SQL, WEIGHTS_SQL)
CYCLE_BASE = (*BASE, _usage_sql("true"), CLASSIFIED)
USED = (*BASE, _usage_sql(), USE.replace("{ceiling}", str(CEILING)))
SEVEN = "round(avg(value) + 1e-6, 3) + 0.0 AS mean, round(stddev_pop(value) + 1e-6, 3) + 0.0 AS std, round(quantile_cont(value, 0.05) + 1e-6, 3) + 0.0 AS q05, round(quantile_cont(value, 0.25) + 1e-6, 3) + 0.0 AS q25, round(quantile_cont(value, 0.5) + 1e-6, 3) + 0.0 AS median, round(quantile_cont(value, 0.75) + 1e-6, 3) + 0.0 AS q75, round(max(value) + 1e-6, 3) + 0.0 AS max"
GOOD = "NOT isnan(value) AND value < 140737488355328"
RATES = f"rates AS (SELECT job_id, metric, (value - lag(value) OVER o) / (ts_s - lag(ts_s) OVER o) AS value FROM samples WHERE {GOOD} WINDOW o AS (PARTITION BY job_id, metric, instance ORDER BY series_pos, sample_pos))"
NAMED = """
pool AS (
  SELECT job_id AS job_db_id, CASE metric WHEN 'click' THEN 'gpu_sm_occupancy' WHEN 'view' THEN 'system_memory' WHEN 'error' THEN 'gpu_power' WHEN 'signup' THEN 'gpu_memory' WHEN 'login' THEN 'gpu_utilization' END AS name,
         CASE WHEN metric = 'view' THEN CASE WHEN job_id % 10 = 3 THEN NULL ELSE value / (job_id + 1) END WHEN metric = 'error' THEN value ELSE value * 0.01 END AS value
  FROM samples WHERE NOT isnan(value) AND value < 140737488355328
  UNION ALL SELECT job_id, 'cpu_utilization', value * 10 FROM rates WHERE metric = 'purchase')"""
TOPS = """
tops AS (SELECT *, CASE WHEN cost = 0 THEN 1.0 ELSE least(1.0, 1 - waste / cost) END AS occupancy, row_number() OVER (PARTITION BY user_id ORDER BY waste DESC, job_db_id) AS worst FROM rows_of)"""

SQL = {
    "a9_metric_statistics": with_sql(SAMPLES_SQL, body=f"SELECT job_id, metric, {SEVEN} FROM samples WHERE {GOOD} GROUP BY ALL"),
    "a9_normalized_statistics": with_sql(SAMPLES_SQL, body=f"SELECT metric, {SEVEN} FROM (SELECT metric, value / 100 AS value FROM samples WHERE {GOOD}) GROUP BY ALL"),
    "a10_counter_rates": with_sql(SAMPLES_SQL, RATES, body="SELECT job_id, metric, count(*) AS n, round(avg(value) * 1000 + 1e-6, 3) + 0.0 AS mean, round(max(value) * 1000 + 1e-6, 3) + 0.0 AS max FROM rates WHERE value IS NOT NULL GROUP BY ALL"),
    "a11_job_statistics": with_sql(SAMPLES_SQL, RATES, NAMED, body=f"SELECT job_db_id, name, {SEVEN} FROM pool WHERE value IS NOT NULL AND name IS NOT NULL GROUP BY ALL"),
    "j17_samples_to_runs": with_sql(SAMPLES_SQL, body="""
, r AS (SELECT DISTINCT job_id, job_id AS run_id, 0.0 AS a, 1705276800.0 AS z FROM samples UNION ALL SELECT DISTINCT job_id, job_id + 100000, 1705280400.0, 1706140800.0 FROM samples WHERE job_id % 3 = 0)
SELECT run_id, metric, sample_pos FROM samples s JOIN r ON r.job_id = s.job_id AND (s.job_id % 3 <> 0 OR ts_s BETWEEN a AND z)""").replace("FROM events)\n, r AS", "FROM events),\nr AS"),
    "s11_upsert_statistics": with_sql(STATS_SQL, body="""
SELECT job_id, name, CASE WHEN job_id % 5 = 0 THEN 2.0::DOUBLE ELSE round(max, 6) END AS max FROM stats UNION ALL SELECT range, 'new', 3.0 FROM range(3)"""),
    "s15_keep_latest": "SELECT l_orderkey AS job_id, 'm' || l_linenumber AS name, max(l_partkey * 100000 + l_suppkey) AS id FROM lineitem GROUP BY ALL",
    "f8_usage_window": with_sql(*BASE, _usage_sql(f"end_s >= {START_S} AND end_s < {END_S} AND cluster_id IN (0, 1, 2)"), body="SELECT job_db_id, round(cost + 1e-6, 3) AS cost, round(waste + 1e-6, 3) AS waste FROM rows_of"),
    "f9_email_selector": with_sql(t.USERS_SQL, body="SELECT id, email FROM users WHERE email NOT IN ('p7@site.org', 'p8@site.org')"),
    "a18_user_usage": with_sql(*USED, body="SELECT user_id, cluster_id, " + ", ".join(f"round({c} + 1e-6, 3) AS {c}" for c in ("rgu_hours", "true_used", "used", "wasted", "user_rgu_hours", "user_used", "user_wasted", "user_ratio")) + " FROM usage_of"),
    "a22_active_users": with_sql(*BASE, _usage_sql(), USE.replace("{ceiling}", "1.0"), body="SELECT user_id, cluster_id, round(rgu_hours + 1e-6, 3) AS rgu_hours FROM usage_of WHERE user_rgu_hours >= 2000"),
    "a23_underusers": with_sql(*USED, body="SELECT user_id, cluster_id, round(wasted + 1e-6, 3) AS wasted FROM usage_of WHERE user_ratio >= 0.45 AND user_wasted >= 500"),
    "a19_classify_cycles": with_sql(*CYCLE_BASE, body="SELECT cycle, user_id, cluster_id, round(rgu_hours + 1e-6, 3) AS rgu_hours, round(wasted + 1e-6, 3) AS wasted, round(sm_occ_mean + 1e-6, 3) AS sm_occ_mean, isunderuser, flagged FROM cls"),
    "a20_escalation_flags": with_sql(*CYCLE_BASE, body="SELECT user_id, cycle, flagged, isunderuser, elevated FROM esc"),
    "w7_cycle_markers": with_sql(*CYCLE_BASE, body="SELECT cycle, CASE WHEN cycle < 1 THEN '' WHEN NOT isunderuser THEN chr(10003) WHEN elevated THEN '!!' || chr(9873) || chr(9650) WHEN flagged THEN chr(9873) || chr(9650) ELSE chr(9650) END AS marker, count(*) AS n FROM esc GROUP BY ALL"),
    "s13_refresh_periods": with_sql(*CYCLE_BASE, body=f"""
SELECT c.user_id, c.cluster_id, strftime(DATE '{ANCHOR}' - CAST(c.cycle * {7 * WEEKS} AS INTEGER), '%Y-%m-%d') AS end_date, round(CASE WHEN c.cluster_id < 4 THEN rgu_hours ELSE -1 END + 1e-6, 3) AS rgu_hours, e.elevated
FROM cls c JOIN esc e ON e.user_id = c.user_id AND e.cycle = c.cycle WHERE DATE '{ANCHOR}' - CAST(c.cycle * {7 * WEEKS} AS INTEGER) >= DATE '1998-01-01' AND (c.cluster_id < 4 OR c.user_id % 2 = 0)"""),
    "a21_recurring_underusers": with_sql(*CYCLE_BASE, REC, body="SELECT user_id, cluster_id, round(wasted + 1e-6, 3) AS wasted, round(true_wasted + 1e-6, 3) AS true_wasted, " + ", ".join(f"{n}{i}" for n, _ in FLAGS for i in range(CYCLES)) + ", round(cluster_share + 1e-6, 3) AS cluster_share FROM rec"),
    "a21_from_periods": with_sql(
        *CYCLE_BASE, AHEAD,
        body="SELECT cluster_id, user_id, round(wasted + 1e-6, 3) AS wasted, round(share + 1e-6, 3) AS cluster_share, " + ", ".join(f"{n}{i}" for n, _ in FLAGS for i in range(CYCLES)) + " FROM ahead",
    ),
    "c20_units": with_sql(*USED, body="""
SELECT user_id, cluster_id, printf('%.1f', h / 168) AS weeks, replace(format('{:,}', CAST(round_even(h * 1000 / 168, 0) AS BIGINT)), ',', ' ') AS whole, printf('%.1f', h / (4.8::DOUBLE * 24 * 7)) AS model_weeks, printf('%.1f', (round(user_ratio, 5) + 1e-7) * 100) || ' %' AS ratio
FROM (SELECT *, round(rgu_hours * 10, 3) + 0.001 AS h FROM usage_of WHERE user_id IS NOT NULL)"""),
    "w3_cumulative_share_cut": with_sql(*CYCLE_BASE, REC, body="SELECT cluster_id, user_id, round(wasted + 1e-6, 3) AS wasted FROM (SELECT *, sum(wasted) OVER (PARTITION BY cluster_id ORDER BY wasted DESC, user_id) - wasted AS b, sum(wasted) OVER (PARTITION BY cluster_id) AS t FROM rec) WHERE b < 0.5 * t OR b = 0"),
    "w2_top_and_bottom_jobs": with_sql(*BASE, _usage_sql(), TOPS, body="""
SELECT user_id, job_db_id, 'worst' AS list, CAST(worst AS INTEGER) AS rank FROM tops WHERE worst <= 2
UNION ALL SELECT user_id, job_db_id, 'best', CAST(r AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occupancy DESC, job_db_id) AS r FROM tops WHERE worst > 2) WHERE r <= 2"""),
    "l3_digest_top": with_sql(*USED, body="SELECT user_id, round(any_value(user_wasted) + 1e-6, 3) AS wasted, arg_max(cluster_id, wasted) AS worst_cluster FROM usage_of GROUP BY user_id ORDER BY any_value(user_wasted) DESC, user_id LIMIT 10"),
    "l4_listing_by_cluster": with_sql(*BASE, _usage_sql(), TOPS, body="""
SELECT user_id, cluster_id, job_db_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY s DESC, cluster_id) AS INTEGER) AS cluster_rank, round(s + 1e-6, 3) AS cluster_sum
FROM (SELECT *, sum(waste) OVER (PARTITION BY user_id, cluster_id) AS s FROM tops WHERE worst <= 3)"""),
    "l7_recipients": with_sql(*USED, body="SELECT DISTINCT user_id FROM usage_of u WHERE user_rgu_hours >= 100 AND NOT EXISTS (SELECT 1 FROM usage_of v WHERE v.user_id = u.user_id AND v.user_ratio >= 0.45 AND v.user_wasted >= 500)"),
    "l8_report_due": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE (weekofyear(o_orderdate) - 1 + 52) % 4 = 0",
    "s14_recurring_table": with_sql(
        *CYCLE_BASE, AHEAD,
        body="SELECT cluster_id, user_id, 'https://usage.invalid/jobs?user=' || user_id AS link, round(wasted, 2) AS wasted, round(share, 4) AS share, '' AS separator, "
        + ", ".join(
            f"CASE WHEN c{i} IS NULL THEN '' WHEN NOT c{i} THEN chr(10003) WHEN e{i} THEN '!!' || chr(9873) || chr(9650) WHEN f{i} THEN chr(9873) || chr(9650) ELSE chr(9650) END AS cycle_{i}" for i in range(CYCLES)
        ) + " FROM ahead",
    ),
}

QUERIES = {name: globals()[name] for name in SQL}
