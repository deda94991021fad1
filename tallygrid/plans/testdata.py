"""Jobs, statistics, users and the rest derived from the given tables by integer rules; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: GPU weights of the derived tables: name, rgu, drac_rgu.
WEIGHTS = [("a100", 4.0, 3.2), ("h100", 8.0, 7.0), ("rtx8000", 1.0, 1.1), ("v100", 2.5, 2.0)]
STATS = ["gpu_utilization", "gpu_sm_occupancy", "gpu_memory", "system_memory", "cpu_utilization", "gpu_power", "gpu_utilization_fp16"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; all times are UTC, so the session's zone is set to it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per order."""
    small = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").join(small.select("c_custkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.selectExpr("o_orderkey AS k", "o_custkey AS u", "n_regionkey AS c", "unix_timestamp(CAST(o_orderdate AS timestamp)) AS submit_s", "o_orderstatus AS st", "o_orderpriority AS pr").selectExpr(
        "*", "IF(k % 53 = 0, NULL, submit_s + k * 7919 % 172800) AS start_s", "CAST(IF(k % 97 = 0, 0, k * 104729 % 1209600) AS double) AS elapsed_time",
    ).selectExpr(
        "k AS job_db_id", "k % 12000 AS job_id", "CAST(c AS bigint) AS cluster_id", "concat('u', u) AS cluster_user", "IF(u % 17 = 0, NULL, CAST(u AS bigint)) AS user_id",
        "CASE st WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'CANCELLED' END AS job_state",
        "timestamp_seconds(submit_s) AS submit_time", "timestamp_seconds(start_s) AS start_time", "elapsed_time",
        "IF(st = 'O' OR start_s IS NULL, NULL, timestamp_seconds(start_s + CAST(elapsed_time AS bigint))) AS end_time",
        "IF(k % 13 = 0, NULL, CAST(3600 * (1 + k % 336) AS bigint)) AS time_limit",
        "CAST(1 + k % 16 AS bigint) AS allocated_cpu", "CAST(1 + k % 12 AS bigint) AS requested_cpu",
        "IF(k % 11 = 0, NULL, CAST(k % 9 AS bigint)) AS allocated_gres_gpu", "IF(k % 11 = 0, NULL, CAST(k % 7 AS bigint)) AS requested_gres_gpu",
        "IF(k % 31 = 0, NULL, CAST(1024 * (k % 64) AS bigint)) AS allocated_mem", "CAST(1 + k % 20 AS bigint) AS allocated_billing",
        "CASE substr(pr, 1, 1) WHEN '1' THEN 'a100' WHEN '2' THEN 'v100' WHEN '3' THEN 'h100' WHEN '5' THEN 'rtx8000' END AS harmonized_gpu_type",
        "CASE substr(pr, 1, 1) WHEN '1' THEN 'gpu:A100' WHEN '2' THEN 'V100' WHEN '3' THEN 'h100' WHEN '5' THEN 'rtx 8000' WHEN '4' THEN IF(k % 2 = 0, 'unknown', NULL) END AS allocated_gpu_type",
        "CASE WHEN k % 29 = 0 THEN array() WHEN k % 3 = 0 THEN array(concat('n', k % 40)) WHEN k % 3 = 1 THEN array(concat('n', k % 40), concat('n', (k + 1) % 40)) ELSE array(concat('n', k % 40), concat('n', (k + 1) % 40), concat('n', (k + 2) % 40)) END AS nodes",
        "concat('job', k % 50) AS name",
    )


JOBS_SQL = """
orders_of AS (
  SELECT o_orderkey AS k, o_custkey AS u, n_regionkey AS c, CAST(epoch(o_orderdate) AS BIGINT) AS submit_s, o_orderstatus AS st, o_orderpriority AS pr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
spans_of AS (
  SELECT *, CASE WHEN k % 53 = 0 THEN NULL ELSE submit_s + k * 7919 % 172800 END AS start_s,
         CAST(CASE WHEN k % 97 = 0 THEN 0 ELSE k * 104729 % 1209600 END AS DOUBLE) AS elapsed_time FROM orders_of),
jobs AS (
  SELECT k AS job_db_id, k % 12000 AS job_id, CAST(c AS BIGINT) AS cluster_id, 'u' || u AS cluster_user, CASE WHEN u % 17 = 0 THEN NULL ELSE CAST(u AS BIGINT) END AS user_id,
         CASE st WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'CANCELLED' END AS job_state, submit_s, start_s, elapsed_time,
         CASE WHEN st = 'O' OR start_s IS NULL THEN NULL ELSE start_s + CAST(elapsed_time AS BIGINT) END AS end_s,
         CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(3600 * (1 + k % 336) AS BIGINT) END AS time_limit,
         CAST(1 + k % 16 AS BIGINT) AS allocated_cpu, CAST(1 + k % 12 AS BIGINT) AS requested_cpu,
         CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 9 AS BIGINT) END AS allocated_gres_gpu, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 7 AS BIGINT) END AS requested_gres_gpu,
         CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(1024 * (k % 64) AS BIGINT) END AS allocated_mem, CAST(1 + k % 20 AS BIGINT) AS allocated_billing,
         CASE pr[1] WHEN '1' THEN 'a100' WHEN '2' THEN 'v100' WHEN '3' THEN 'h100' WHEN '5' THEN 'rtx8000' END AS harmonized_gpu_type,
         CASE pr[1] WHEN '1' THEN 'gpu:A100' WHEN '2' THEN 'V100' WHEN '3' THEN 'h100' WHEN '5' THEN 'rtx 8000' WHEN '4' THEN CASE WHEN k % 2 = 0 THEN 'unknown' END END AS allocated_gpu_type,
         CASE WHEN k % 29 = 0 THEN []::VARCHAR[] WHEN k % 3 = 0 THEN ['n' || k % 40] WHEN k % 3 = 1 THEN ['n' || k % 40, 'n' || (k + 1) % 40] ELSE ['n' || k % 40, 'n' || (k + 1) % 40, 'n' || (k + 2) % 40] END AS nodes,
         'job' || k % 50 AS name
  FROM spans_of)"""


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven numbers per (job, metric), one metric per line number; NaN and null at fixed residues."""
    names = F.array(*map(F.lit, STATS))
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("q"), F.max("l_extendedprice").cast("double").alias("p"))
    x = x.filter("l_linenumber BETWEEN 1 AND 7").select(F.col("l_orderkey").alias("job_id"), F.element_at(names, F.col("l_linenumber").cast("int")).alias("name"), "q", "p", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 43).alias("r"))
    mean = F.when(F.col("r") == 1, F.lit(float("nan"))).when(F.col("r") == 2, F.lit(None)).otherwise(F.col("q") / 51)
    top = (F.col("p").cast("long") % 1000) / 997
    return x.select("job_id", "name", mean.alias("mean"), (F.col("q") / 500).alias("std"), (F.col("q") / 102).alias("q05"), (F.col("q") / 77).alias("q25"), (F.col("q") / 49).alias("median"), (F.col("q") / 40).alias("q75"), top.alias("max"))


STATS_SQL = """
stats AS (
  SELECT l_orderkey AS job_id, ['gpu_utilization', 'gpu_sm_occupancy', 'gpu_memory', 'system_memory', 'cpu_utilization', 'gpu_power', 'gpu_utilization_fp16'][l_linenumber] AS name,
         CASE WHEN r = 1 THEN CAST('nan' AS DOUBLE) WHEN r = 2 THEN NULL ELSE q / 51 END AS mean, q / 500 AS std, q / 102 AS q05, q / 77 AS q25, q / 49 AS median, q / 40 AS q75, (CAST(trunc(p) AS BIGINT) % 1000) / 997.0::DOUBLE AS max
  FROM (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS DOUBLE) AS q, CAST(max(l_extendedprice) AS DOUBLE) AS p, (l_orderkey * 7 + l_linenumber) % 43 AS r
        FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY ALL))"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS bigint) AS id", "lower(r_name) AS name", "IF(r_regionkey % 2 = 0, 'north', 'south') AS domain", "r_regionkey % 2 = 0 AS billing_is_gpu")


CLUSTERS_SQL = "clusters AS (SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'north' ELSE 'south' END AS domain, r_regionkey % 2 = 0 AS billing_is_gpu FROM region)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS bigint) AS id", "c_name AS display_name", "IF(c_custkey % 23 = 0, '', concat('p', c_custkey % 700, '@site.org')) AS email")


USERS_SQL = "users AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS display_name, CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'p' || c_custkey % 700 || '@site.org' END AS email FROM customer)"


def weights(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{n}', CAST({a} AS double), CAST({b} AS double))" for n, a, b in WEIGHTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(name, rgu, drac_rgu)")


WEIGHTS_SQL = "weights(name, rgu, drac_rgu) AS (VALUES " + ", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for n, a, b in WEIGHTS) + ")"


def member_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two member types per user around a date of their own, with a gap for some."""
    cut = "timestamp_seconds(852076800 + (c_custkey % 700) * 86400)"
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS bigint) AS user_id",
        f"inline(array(named_struct('member_type', concat('type', c_custkey % 3), 'valid_from', CAST(NULL AS timestamp), 'valid_to', {cut}), "
        f"named_struct('member_type', concat('type', (c_custkey + 1) % 3), 'valid_from', {cut} + make_interval(0, 0, 0, CAST(c_custkey % 5 AS int)), 'valid_to', CAST(NULL AS timestamp))))",
    )


MEMBERS_SQL = """
members AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_id, 'type' || c_custkey % 3 AS member_type, NULL AS from_s, 852076800 + (c_custkey % 700) * 86400 AS to_s FROM customer
  UNION ALL SELECT CAST(c_custkey AS BIGINT), 'type' || (c_custkey + 1) % 3, 852076800 + (c_custkey % 700 + c_custkey % 5) * 86400, NULL FROM customer)"""


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts per (domain, username): on the northern domain the login changed hands once."""
    cut = "timestamp_seconds(883612800)"
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('u', c_custkey) AS username",
        f"inline(array(named_struct('domain', 'north', 'user_id', CAST(c_custkey AS bigint), 'valid_from', CAST(NULL AS timestamp), 'valid_to', {cut}), "
        f"named_struct('domain', 'north', 'user_id', CAST(c_custkey + 1000000 AS bigint), 'valid_from', {cut}, 'valid_to', CAST(NULL AS timestamp)), "
        f"named_struct('domain', IF(c_custkey % 7 = 0, 'west', 'south'), 'user_id', CAST(c_custkey AS bigint), 'valid_from', CAST(NULL AS timestamp), 'valid_to', CAST(NULL AS timestamp))))",
    )


CREDENTIALS_SQL = """
credentials AS (
  SELECT 'u' || c_custkey AS username, 'north' AS domain, CAST(c_custkey AS BIGINT) AS user_id, NULL AS from_s, 883612800 AS to_s FROM customer
  UNION ALL SELECT 'u' || c_custkey, 'north', CAST(c_custkey + 1000000 AS BIGINT), 883612800, NULL FROM customer
  UNION ALL SELECT 'u' || c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'west' ELSE 'south' END, CAST(c_custkey AS BIGINT), NULL, NULL FROM customer)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples from the events: a job per user, a series per (metric, instance); sentinels and NaN at fixed residues."""
    e = table(spark, sf_dir, "events")
    value = "CASE WHEN event_id % 101 = 0 THEN CAST('NaN' AS double) WHEN event_id % 103 = 0 THEN CAST(140737488355328 + event_id % 4 AS double) ELSE CAST(value AS double) END"
    return e.selectExpr("CAST(user_id AS bigint) AS job_id", "event_type AS metric", "map('instance', concat('i', event_id % 3)) AS labels", "CAST(event_id % 3 AS int) AS series_pos", "CAST(event_id AS bigint) AS sample_pos", "unix_micros(CAST(ts AS timestamp)) / 1e6 AS ts_s", f"{value} AS value")


SAMPLES_SQL = """
samples AS (
  SELECT CAST(user_id AS BIGINT) AS job_id, event_type AS metric, 'i' || event_id % 3 AS instance, event_id % 3 AS series_pos, event_id AS sample_pos, epoch_us(ts) / 1e6 AS ts_s,
         CASE WHEN event_id % 101 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 103 = 0 THEN CAST(140737488355328 + event_id % 4 AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS value
  FROM events)"""


def with_sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()
