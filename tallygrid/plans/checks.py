"""Registered queries over data quality and reports, each with its SQL."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import functions as F

from tallygrid.functions import timeaxis as ta
from tallygrid.operators import quality as q, reports as r
from tallygrid.plans import testdata as t
from tallygrid.plans.testdata import CLUSTERS_SQL, JOBS_SQL, STATS_SQL, USERS_SQL, with_sql
from tallygrid.plans.underuses import r3

LO, HI = datetime(1998, 1, 1), datetime(1998, 4, 1)
LO_S, HI_S = 883612800, 891388800
NOW, NOW_S = datetime(2001, 6, 1), 991353600
EFF = "eff AS (SELECT *, coalesce(start_s, submit_s) AS es, coalesce(end_s, start_s + elapsed_time, submit_s) AS ee FROM jobs)"
CLIP = f"(least(ee, {HI_S}) - greatest(es, {LO_S}))"
FRAME_S = 864000
N_FRAMES = (HI_S - LO_S) // FRAME_S
FRAMED = f"frm AS (SELECT eff.*, k AS frame FROM eff JOIN (SELECT CAST(unnest(range({N_FRAMES})) AS INTEGER) AS k) ON es < {LO_S} + (k + 1) * {FRAME_S} AND ee >= {LO_S} + k * {FRAME_S})"


def f11_jobs_missing_statistics(s, f):
    jobs = t.jobs(s, f)
    tried = jobs.filter("job_db_id % 6 = 1").select(F.col("job_db_id").alias("job_id"))
    return q.jobs_missing_statistics(jobs, t.statistics(s, f).filter("name <> 'gpu_power'"), tried, 2, 200).select("job_db_id")


def f12_jobs_missing_gpu_name(s, f):
    return q.jobs_missing_gpu_name(t.jobs(s, f)).select("job_db_id", "allocated_gpu_type")


def f13_stale_clusters(s, f):
    last = t.jobs(s, f).groupBy("cluster_id").agg(F.max("end_time").alias("last"))
    rows = t.clusters(s, f).join(last.filter("cluster_id <> 3"), F.col("id") == F.col("cluster_id"), "left")
    return q.stale_clusters(rows, "last", NOW + timedelta(days=80), timedelta(days=1)).select("id", "name")


def f14_old_running_jobs(s, f):
    return q.old_running_jobs(t.jobs(s, f), NOW, datetime(1999, 1, 1)).select("job_db_id")


def a29_running_resubmissions(s, f):
    return q.running_resubmissions(t.jobs(s, f), NOW, datetime(1996, 1, 1))


def a12_duplicate_job_ids(s, f):
    return q.duplicate_job_ids(t.jobs(s, f), datetime(1996, 1, 1), NOW)


def a13_gpu_share_per_node(s, f):
    return r3(q.gpu_share_per_node(t.jobs(s, f), LO, HI, "a100", 0.25, 3600, 5, [4]), "share")


def a14_low_gpu_users(s, f):
    return r3(q.low_gpu_users(t.jobs(s, f), t.statistics(s, f), LO, HI, 400000.0, 3600), "gpu_seconds")


def a15_scraping_volume(s, f):
    return r3(q.scraping_volume(t.jobs(s, f), t.clusters(s, f), LO, HI, FRAME_S, 0.8), "threshold")


def a16_statistics_coverage(s, f):
    return r3(q.statistics_coverage(t.jobs(s, f), t.statistics(s, f), ["gpu_utilization", "gpu_memory"], LO, HI, FRAME_S, 1.0, True, [1, 2], 60, 3), "share", "threshold")


def a16_cpu_coverage(s, f):
    return r3(q.statistics_coverage(t.jobs(s, f), t.statistics(s, f), ["cpu_utilization", "system_memory"], LO, HI, FRAME_S, 0.5, False), "share", "threshold")


def a17_duplicate_emails(s, f):
    return q.duplicate_users(t.users(s, f), "email").select("email", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def j19_expected_missing(s, f):
    jobs = t.jobs(s, f)
    return q.expected_missing(jobs.select(F.explode("nodes").alias("node")), jobs.filter("job_db_id % 40 < 30 AND size(nodes) > 0").select(F.col("nodes")[0].alias("node")), "node")


def l6_set_difference(s, f):
    jobs = t.jobs(s, f)
    return q.set_difference(jobs.filter("cluster_id = 0").select("cluster_user"), jobs.filter("job_state = 'RUNNING'").select("cluster_user"), "cluster_user")


def c9_focus_window(s, f):
    """Jobs submitted in a window given the wrong way round, cut to a focus."""
    lo, hi = ta.date_range(date(1998, 7, 2), date(1998, 1, 7), date(2001, 6, 1), focus=(date(1999, 1, 1), date(1998, 3, 1)))
    return t.jobs(s, f).filter((F.col("submit_time") >= F.lit(lo)) & (F.col("submit_time") < F.lit(hi))).select("job_db_id")


def c16_due_intervals(s, f):
    """Jobs submitted in each interval that is due between a mark and now."""
    rows = [(int(a.replace(tzinfo=UTC).timestamp()), int(b.replace(tzinfo=UTC).timestamp())) for a, b in ta.due_intervals(LO, datetime(1998, 4, 3, 5), 7 * 24 * 60)]
    due = F.broadcast(s.createDataFrame(rows, "lo_s long, hi_s long"))  # a row per interval
    at = F.unix_timestamp("submit_time")
    return due.join(t.jobs(s, f).select(at.alias("at")), (F.col("at") >= F.col("lo_s")) & (F.col("at") < F.col("hi_s")), "left").groupBy("lo_s", "hi_s").agg(F.count("at").alias("n_jobs"))


def w1_time_frames(s, f):
    jobs = t.jobs(s, f).select("job_db_id", "start_time", "end_time", F.col("allocated_cpu").cast("double").alias("cost"))
    out = r.time_frames(jobs, ["cost"], start=LO, end=HI)
    return r3(out.select("job_db_id", F.unix_timestamp("timestamp").alias("frame_s"), F.unix_timestamp("start_time").alias("start_s"), "duration", F.when(~F.isnan("cost"), F.col("cost")).alias("cost")), "duration", "cost")


def w1_default_frames(s, f):
    jobs = t.jobs(s, f).select("job_db_id", "start_time", "end_time")
    out = r.time_frames(jobs, size_s=30 * 86400)
    return out.groupBy(F.unix_timestamp("timestamp").alias("frame_s")).agg(F.count("*").alias("n"), F.round(F.sum("duration"), 0).alias("seconds"))


def a24_hours_by_category(s, f):
    return r3(r.hours_by_category(t.jobs(s, f), LO, datetime(1999, 1, 1)), "gpu_hours", "share")


def a25_billed_by_cluster(s, f):
    return r3(r.billed_by_cluster_and_gpus(t.jobs(s, f), [0, 1, 2, 3, 4]), *[f"cluster_{i}" for i in range(5)])


def a26_allocation_vs_usage(s, f):
    a = s.sql("SELECT CAST(id % 5 AS bigint) AS cluster_id, add_months(DATE '1996-04-01', CAST(12 * (id div 5) AS int)) AS start, add_months(DATE '1997-04-01', CAST(12 * (id div 5) AS int)) AS end, CAST(id + 1 AS double) AS years FROM range(20)")
    out = r.allocation_vs_usage(t.jobs(s, f), a).withColumn("month", F.date_format("month", "yyyy-MM-dd"))
    return r3(out, "billed", "projected", "running", "allocated")


def a27_waste_by_user(s, f):
    util = t.statistics(s, f).filter("name = 'gpu_utilization' AND mean IS NOT NULL AND NOT isnan(mean)").select(F.col("job_id").alias("job_db_id"), F.col("mean").alias("utilization"))
    rows = t.jobs(s, f).join(util, "job_db_id").select(F.col("cluster_user").alias("user"), "utilization", "elapsed_time", F.coalesce("requested_gres_gpu", F.lit(0)).alias("requested"), F.col("allocated_billing").alias("billing"), F.col("allocated_gres_gpu").alias("gpus"))
    return r3(r.waste_by_user(rows), "used", "wasted", "overbilled", "ratio", "total_ratio")


def a28_tool_adoption(s, f):
    return r.tool_adoption(t.jobs(s, f), "job7", every_week=False).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def _coverage(kind: str, names: list[str], k: float, group: str, more: str, least: int) -> str:
    shares = ", ".join(f"sum(CASE WHEN has_{n} THEN 1 ELSE 0 END) / count(*)::DOUBLE AS s_{n}" for n in names)
    tall = " UNION ALL ".join(f"SELECT frame, cluster_id, node, n_jobs, '{n}' AS name, s_{n} AS share FROM cnt" for n in names)
    return with_sql(JOBS_SQL, STATS_SQL, EFF, FRAMED, body=f"""
, nod AS (SELECT job_db_id, cluster_id, frame, unnest(nodes) AS node FROM frm WHERE {kind} {more}),
has AS (SELECT job_id, {', '.join(f"bool_or(name = '{n}') AS has_{n}" for n in names)} FROM stats GROUP BY 1),
cnt AS (SELECT frame, cluster_id, {group} AS node, count(*) AS n_jobs, {shares} FROM nod LEFT JOIN has ON job_id = job_db_id GROUP BY 1, 2, 3),
tal AS ({tall}),
bnd AS (SELECT name, greatest(0.0, avg(share) - {k} * stddev_samp(share)) AS threshold FROM tal GROUP BY 1)
SELECT name, frame, cluster_id, node, n_jobs, round(share + 1e-6, 3) AS share, round(threshold + 1e-6, 3) AS threshold FROM tal JOIN bnd USING (name) WHERE n_jobs >= {least} AND share < coalesce(threshold, 0)""").replace(")\n, nod AS", "),\nnod AS")


SQL = {
    "f11_jobs_missing_statistics": with_sql(JOBS_SQL, STATS_SQL, body="""
SELECT job_db_id FROM jobs WHERE cluster_id = 2 AND job_state <> 'RUNNING' AND elapsed_time <> 0 AND job_db_id % 6 <> 1
AND NOT EXISTS (SELECT 1 FROM stats WHERE job_id = job_db_id AND name <> 'gpu_power') ORDER BY submit_s DESC, job_db_id LIMIT 200"""),
    "f12_jobs_missing_gpu_name": with_sql(JOBS_SQL, body="SELECT job_db_id, allocated_gpu_type FROM jobs WHERE allocated_gpu_type IS NOT NULL AND harmonized_gpu_type IS NULL"),
    "f13_stale_clusters": with_sql(JOBS_SQL, CLUSTERS_SQL, body=f"SELECT id, name FROM clusters LEFT JOIN (SELECT cluster_id, max(end_s) AS last FROM jobs WHERE cluster_id <> 3 GROUP BY 1) ON cluster_id = id WHERE last IS NULL OR last < {NOW_S + 79 * 86400}"),
    "f14_old_running_jobs": with_sql(JOBS_SQL, body=f"SELECT job_db_id FROM jobs WHERE job_state = 'RUNNING' AND start_s + time_limit < {NOW_S} AND submit_s >= 915148800"),
    "a29_running_resubmissions": with_sql(JOBS_SQL, body=f"""
, recent AS (SELECT * FROM jobs WHERE submit_s >= 820454400), hit AS (SELECT * FROM recent WHERE job_state = 'RUNNING' AND start_s + time_limit < {NOW_S}),
st AS (SELECT cluster_id, job_id, count(*) AS n, arg_max(job_state, submit_s * 10000000 + job_db_id) AS latest FROM recent SEMI JOIN hit USING (cluster_id, job_id) GROUP BY ALL)
SELECT 'entries' AS what, count(*) AS n FROM hit UNION ALL SELECT 'jobs', count(*) FROM (SELECT DISTINCT cluster_id, job_id FROM hit)
UNION ALL SELECT CASE WHEN n = 1 THEN 'single' ELSE 'latest:' || latest END, count(*) FROM st GROUP BY 1""").replace(")\n, recent", "),\nrecent"),
    "a12_duplicate_job_ids": with_sql(JOBS_SQL, body=f"""
SELECT job_id, CAST(sum(n) AS BIGINT) AS n, string_agg(cluster_id || ':' || n, ' ' ORDER BY n DESC, cluster_id) AS per_cluster
FROM (SELECT job_id, cluster_id, count(*) AS n FROM jobs WHERE submit_s >= 820454400 AND submit_s < {NOW_S} GROUP BY ALL) GROUP BY 1 HAVING sum(n) > 1"""),
    "a13_gpu_share_per_node": with_sql(JOBS_SQL, EFF, body=f"""
SELECT cluster_id, node, CAST(sum(hit) AS BIGINT) AS on_type, count(*) AS n_jobs, round(sum(hit) / count(*)::DOUBLE + 1e-6, 3) AS share
FROM (SELECT cluster_id, unnest(nodes) AS node, CASE WHEN harmonized_gpu_type = 'a100' OR allocated_gpu_type = 'a100' THEN 1 ELSE 0 END AS hit FROM eff WHERE es < {HI_S} AND ee > {LO_S} AND {CLIP} >= 3600 AND allocated_gres_gpu > 0)
GROUP BY 1, 2 HAVING sum(hit) / count(*)::DOUBLE < 0.25 AND (count(*) >= 5 OR cluster_id = 4)"""),
    "a14_low_gpu_users": with_sql(JOBS_SQL, STATS_SQL, EFF, body=f"""
SELECT cluster_user, round(avg(CASE WHEN median <= 1 THEN median END * {CLIP} * allocated_gres_gpu) + 1e-6, 3) AS gpu_seconds FROM eff LEFT JOIN stats ON stats.job_id = job_db_id AND stats.name = 'gpu_utilization'
WHERE es < {HI_S} AND ee > {LO_S} AND {CLIP} >= 3600 AND allocated_gres_gpu > 0 GROUP BY 1 HAVING coalesce(avg(CASE WHEN median <= 1 THEN median END * {CLIP} * allocated_gres_gpu), 0) < 400000"""),
    "a15_scraping_volume": with_sql(JOBS_SQL, CLUSTERS_SQL, EFF, FRAMED, body=f"""
, g AS (SELECT id AS cluster_id, k AS frame FROM clusters CROSS JOIN (SELECT CAST(unnest(range({N_FRAMES})) AS INTEGER) AS k)),
d AS (SELECT g.cluster_id, g.frame, count(frm.job_db_id) AS n_jobs FROM g LEFT JOIN frm ON frm.cluster_id = g.cluster_id AND frm.frame = g.frame GROUP BY ALL),
x AS (SELECT *, greatest(0.0, avg(n_jobs) OVER c - 0.8 * coalesce(stddev_samp(n_jobs) OVER c, 0)) AS threshold FROM d WINDOW c AS (PARTITION BY cluster_id))
SELECT cluster_id, frame, n_jobs, round(threshold + 1e-6, 3) AS threshold FROM x WHERE n_jobs < threshold OR threshold = 0""").replace(")\n, g AS", "),\ng AS"),
    "a16_statistics_coverage": _coverage("allocated_gres_gpu > 0", ["gpu_utilization", "gpu_memory"], 1.0, "CASE WHEN cluster_id IN (1, 2) THEN node ELSE '(all)' END", f"AND {CLIP} >= 60", 3),
    "a16_cpu_coverage": _coverage("allocated_gres_gpu = 0", ["cpu_utilization", "system_memory"], 0.5, "'(all)'", f"AND {CLIP} >= 0", 1),
    "a17_duplicate_emails": with_sql(USERS_SQL, body="SELECT email, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM users WHERE email <> '' GROUP BY 1 HAVING count(*) > 1"),
    "j19_expected_missing": with_sql(JOBS_SQL, body="SELECT DISTINCT node FROM (SELECT unnest(nodes) AS node FROM jobs) WHERE node NOT IN (SELECT nodes[1] FROM jobs WHERE job_db_id % 40 < 30 AND len(nodes) > 0)"),
    "l6_set_difference": with_sql(JOBS_SQL, body="SELECT cluster_user FROM jobs WHERE cluster_id = 0 EXCEPT SELECT cluster_user FROM jobs WHERE job_state = 'RUNNING'"),
    "c9_focus_window": with_sql(JOBS_SQL, body="SELECT job_db_id FROM jobs WHERE submit_s >= 888710400 AND submit_s < 899337600"),
    "c16_due_intervals": with_sql(JOBS_SQL, body=f"SELECT lo AS lo_s, lo + 604800 AS hi_s, count(job_db_id) AS n_jobs FROM (SELECT {LO_S} + 604800 * unnest(range(13)) AS lo) LEFT JOIN jobs ON submit_s >= lo AND submit_s < lo + 604800 GROUP BY 1"),
    "w1_time_frames": with_sql(JOBS_SQL, body=f"""
SELECT job_db_id, {LO_S} + k * 604800 AS frame_s, CAST(greatest(start_s, {LO_S} + k * 604800) AS BIGINT) AS start_s, round(least(end_s, {LO_S} + (k + 1) * 604800) - greatest(start_s, {LO_S} + k * 604800) + 1e-6, 3) AS duration,
       round(allocated_cpu * (least(end_s, {LO_S} + (k + 1) * 604800) - greatest(start_s, {LO_S} + k * 604800)) / nullif(end_s - start_s, 0)::DOUBLE + 1e-6, 3) AS cost
FROM jobs JOIN (SELECT unnest(range({(HI_S - LO_S) // 604800 + 1})) AS k) ON start_s < {LO_S} + (k + 1) * 604800 AND end_s > {LO_S} + k * 604800"""),
    "w1_default_frames": with_sql(JOBS_SQL, body="""
, p AS (SELECT * FROM jobs), m AS (SELECT min(start_s) AS lo, max(end_s) AS hi FROM p), fr AS (SELECT unnest(generate_series(lo, hi, 2592000)) AS a FROM m)
SELECT a AS frame_s, count(*) AS n, round(sum(least(end_s, a + 2592000) - greatest(start_s, a)), 0) AS seconds FROM p JOIN fr ON start_s < a + 2592000 AND end_s > a GROUP BY 1""").replace(")\n, p AS", "),\np AS"),
    "a24_hours_by_category": with_sql(JOBS_SQL, body=f"""
, x AS (SELECT greatest(least(end_s, 915148800) - greatest(end_s - elapsed_time, {LO_S}), 0) / 3600 * allocated_gres_gpu AS h, elapsed_time AS t, allocated_gres_gpu AS g, elapsed_time / 3600 * allocated_gres_gpu AS gh FROM jobs WHERE allocated_gres_gpu > 0 AND end_s IS NOT NULL),
y AS (
  SELECT h, 'duration' AS "by", CASE WHEN t < 3600 THEN '< 1 h' WHEN t < 86400 THEN '1-24 h' WHEN t < 2419200 THEN '1-28 d' ELSE '>= 28 d' END AS category FROM x WHERE h > 0
  UNION ALL SELECT h, 'gpus', CASE WHEN g = 1 THEN '1' WHEN g <= 4 THEN '2-4' WHEN g <= 8 THEN '5-8' WHEN g <= 32 THEN '9-32' ELSE '>= 33' END FROM x WHERE h > 0
  UNION ALL SELECT h, 'size', CASE WHEN gh < 1 THEN '< 1 GPU h' WHEN gh < 24 THEN '1-24 GPU h' WHEN gh < 672 THEN '24-672 GPU h' ELSE '>= 672 GPU h' END FROM x WHERE h > 0)
SELECT "by", category, round(sum(h) + 1e-6, 3) AS gpu_hours, round(sum(h) / sum(sum(h)) OVER (PARTITION BY "by") + 1e-6, 3) AS share FROM y GROUP BY 1, 2""").replace(")\n, x AS", "),\nx AS"),
    "a25_billed_by_cluster": with_sql(JOBS_SQL, body="SELECT allocated_gres_gpu, " + ", ".join(f"round(sum(elapsed_time * allocated_billing / 31557600.0::DOUBLE) FILTER (WHERE cluster_id = {i}) + 1e-6, 3) AS cluster_{i}" for i in range(5)) + " FROM jobs GROUP BY 1"),
    "a26_allocation_vs_usage": with_sql(JOBS_SQL, body="""
, a AS (SELECT id % 5 AS c, DATE '1996-04-01' + INTERVAL 1 YEAR * (id // 5) AS s, DATE '1997-04-01' + INTERVAL 1 YEAR * (id // 5) AS e, id + 1.0 AS years FROM (SELECT unnest(range(20)) AS id)),
u AS (SELECT cluster_id, date_trunc('month', make_timestamp(start_s * 1000000)) AS month, sum(elapsed_time * allocated_billing) / 31557600.0::DOUBLE AS billed FROM jobs WHERE start_s IS NOT NULL GROUP BY ALL)
SELECT cluster_id, strftime(month, '%Y-%m-%d') AS month, round(billed + 1e-6, 3) AS billed, round(billed * 12 + 1e-6, 3) AS projected, round(sum(billed) OVER (PARTITION BY cluster_id ORDER BY month) + 1e-6, 3) AS running,
       round(CAST((SELECT sum(years) FROM a WHERE c = cluster_id AND month >= s AND month < e) AS DOUBLE) + 1e-6, 3) AS allocated FROM u""").replace(")\n, a AS", "),\na AS"),
    "a27_waste_by_user": with_sql(JOBS_SQL, STATS_SQL, body="""
, x AS (SELECT cluster_user AS u, mean AS m, elapsed_time AS t, greatest(allocated_billing, allocated_gres_gpu) - coalesce(requested_gres_gpu, 0) AS o FROM jobs JOIN stats s ON s.job_id = job_db_id AND s.name = 'gpu_utilization' WHERE mean IS NOT NULL AND NOT isnan(mean) AND elapsed_time >= 60)
SELECT u AS "user", round(sum(m * t) + 1e-6, 3) AS used, round(sum((1 - m) * t) + 1e-6, 3) AS wasted, round(sum(o * t) + 1e-6, 3) AS overbilled, round(sum((1 - m) * t) / sum(m * t) + 1e-6, 3) AS ratio, round((sum((1 - m) * t) + sum(o * t)) / sum(m * t) + 1e-6, 3) AS total_ratio FROM x GROUP BY 1""").replace(")\n, x AS", "),\nx AS"),
    "a28_tool_adoption": with_sql(JOBS_SQL, body="""
, x AS (SELECT date_trunc('week', make_timestamp(submit_s * 1000000)) AS week, cluster_user AS u, bool_or(name = 'job7') AS hit FROM jobs GROUP BY ALL),
f AS (SELECT u, min(week) AS first, min(week) FILTER (WHERE hit) AS fh FROM x GROUP BY 1)
SELECT strftime(week, '%Y-%m-%d') AS week, count(*) AS users, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS tool_users, (SELECT count(*) FROM f WHERE first <= x.week) AS users_so_far,
       (SELECT count(*) FROM f WHERE fh <= x.week) AS tool_users_so_far, CAST(sum(CASE WHEN fh <= x.week THEN 1 ELSE 0 END) AS BIGINT) AS users_with_tool
FROM x JOIN f USING (u) GROUP BY x.week""").replace(")\n, x AS", "),\nx AS"),
}

QUERIES = {name: globals()[name] for name in SQL}
