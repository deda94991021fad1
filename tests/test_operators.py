"""Operators on small made-up rows: boundaries, nulls, NaN, invariants."""

import math
import random
from collections import Counter
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import gpunames as g, timeaxis as ta
from tallygrid.operators import dashboard as d, jobseries as js, people as p, quality as q, reports as r, samples as sm, underuse as uu
from tallygrid.plans import intake
from tallygrid.sources import records as rec
from tallygrid.streaming import streams

LO, HI = datetime(2024, 1, 1), datetime(2024, 1, 29)
H = timedelta(hours=1)
JOB = "job_db_id long, cluster_id long, user_id long, cluster_user string, job_state string, submit_time timestamp, start_time timestamp, end_time timestamp, elapsed_time double, allocated_gres_gpu long, requested_gres_gpu long, harmonized_gpu_type string, allocated_gpu_type string, nodes array<string>, time_limit long, allocated_cpu long, requested_cpu long"
STAT = "job_id long, name string, mean double, std double, q05 double, q25 double, median double, q75 double, max double"


def job(i, start, hours, gpus=1, gpu="g", cluster=0, user=1, state="COMPLETED", nodes=("n1",), end="auto"):
    e = start + hours * H if start is not None and end == "auto" else (None if end == "auto" else end)
    return (i, cluster, user, f"u{user}", state, (start or LO) - timedelta(seconds=60), start, e, hours * 3600.0, gpus, 1, gpu, gpu, list(nodes), 3600, 4, 2)


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([("g", 10.0, 8.0)], "name string, rgu double, drac_rgu double")


WINDOW_JOBS = [
    (job(1, LO + 24 * H, 5), 5), (job(2, LO - 2 * H, 5), 3), (job(3, HI - 2 * H, 5), 2), (job(4, LO - 10 * H, 2000), 28 * 24), (job(5, LO, 4), 4), (job(6, LO - 4 * H, 4), 0), (job(7, HI, 4), 0),
    (job(8, LO - 30 * H, 4), 0), (job(9, HI + 5 * H, 4), 0), (job(10, LO + 5 * H, 0), 0), (job(11, None, 7), 0), (job(12, LO + 40 * H, 6, end=None, state="RUNNING"), 6), (job(13, LO + 7 * 24 * H - 3 * H, 5), 5),
]


@pytest.mark.parametrize("period", ["w", "m", "d", "5d", "36h"])
def test_overlap_is_exact_and_additive(spark, weights, period):
    jobs = spark.createDataFrame([x for x, _ in WINDOW_JOBS], JOB)
    whole = d.rgu_by_cluster(jobs, weights, ta.Axis(LO, HI, ta.parse_period(period)))
    assert whole.agg(F.sum("rgu_hours")).first()[0] == pytest.approx(10 * sum(h for _, h in WINDOW_JOBS))
    cut = LO + 11 * 24 * H + 5 * H
    halves = [d.rgu_by_cluster(jobs, weights, ta.Axis(a, b, ta.parse_period(period))).agg(F.sum("rgu_hours")).first()[0] for a, b in ((LO, cut), (cut, HI))]
    assert sum(halves) == pytest.approx(10 * sum(h for _, h in WINDOW_JOBS))
    per_job = {x["job_db_id"]: x["h"] for x in ta.span_to_buckets(jobs, ta.Axis(LO, HI, ta.parse_period(period))).groupBy("job_db_id").agg(F.sum("overlap_h").alias("h")).collect()}
    assert per_job == {x[0]: pytest.approx(h) for x, h in WINDOW_JOBS if h}


@pytest.mark.parametrize("period", ["h", "d", "w", "m", "3d", "7h"])
def test_axis_tiles_the_window(spark, period):
    lo, hi = datetime(2024, 1, 10, 7, 30), datetime(2024, 4, 2, 13)
    rows = ta.Axis(lo, hi, ta.parse_period(period)).frame(spark).orderBy("bucket").collect()
    assert (rows[0]["lo_s"], rows[-1]["hi_s"]) == (ta.epoch(lo), ta.epoch(hi))
    assert all(a["hi_s"] == b["lo_s"] for a, b in zip(rows, rows[1:])) and all(x["lo_s"] < x["hi_s"] for x in rows)
    assert ta.Axis(hi, hi, ta.parse_period(period)).frame(spark).count() == 0


def test_empty_buckets_are_zero(spark):
    jobs = spark.createDataFrame([job(1, LO + H, 1)], JOB)
    for submitted in (False, True):
        got = d.job_counts(jobs, ta.Axis(LO, HI, ta.parse_period("7d")), submitted=submitted).orderBy("bucket_s").collect()
        assert [x["n_jobs"] for x in got] == [1, 0, 0, 0]
    assert d.job_counts(jobs.limit(0), ta.Axis(LO, HI, ta.parse_period("w"))).agg(F.sum("n_jobs")).first()[0] == 0


def test_views_agree_and_nan_is_unmeasured(spark, weights):
    jobs = spark.createDataFrame([job(i, LO + i * H, 10, user=i % 2) for i in range(4)], JOB)
    stats = spark.createDataFrame([(0, "gpu_sm_occupancy", 0.5, *[0.1] * 6), (1, "gpu_sm_occupancy", math.nan, *[0.1] * 6), (2, "gpu_sm_occupancy", None, *[0.1] * 6)], STAT)
    axis = ta.Axis(LO, HI, ta.parse_period("28d"))
    u = d.rgu_usage(jobs, stats, weights, axis, minimum=0.7).first()
    assert (u["allocated"], u["used"], u["unmeasured"], u["wasted"]) == (400, 50, 300, pytest.approx(20)) and u["gpu_sm_occupancy_mean"] == 0.5 and u["gpu_utilization_mean"] is None
    users = {x["login"]: x for x in d.rgu_by_user(jobs, stats, weights, LO, HI).collect()}
    assert sum(x["requested"] for x in users.values()) == 400 and sum(x["unmeasured"] for x in users.values()) == 300
    assert d.metric_distribution(jobs, stats, weights, LO, HI, "gpu_sm_occupancy").collect()[0]["rgu_seconds"] == 360_000
    assert d.metric_trend(jobs, stats, ta.Axis(LO, HI, ta.parse_period("14d")), "gpu_sm_occupancy").orderBy("bucket_s").collect()[1]["avg_mean"] is None


def test_paging_is_one_order(spark, weights):
    jobs = spark.createDataFrame([job(i, LO + (i % 3) * H, 1 + i % 4) for i in range(23)], JOB).withColumns({"job_id": F.col("job_db_id") % 5, "allocated_billing": F.when(F.col("job_db_id") % 3 > 0, F.col("job_db_id") % 4)})
    stats = spark.createDataFrame([(i, n, float("nan") if i == 4 else i % 3 / 10, *[0.0] * 5, 0.5) for i in range(0, 23, 2) for n in ("gpu_sm_occupancy", "gpu_memory")], STAT)
    for sort in d.SORT_KEYS:
        pages = [x["job_db_id"] for k in range(0, 23, 5) for x in d.jobs_table(jobs, stats, weights, LO, HI, sort=sort, limit=5, offset=k).collect()]
        assert pages == [x["job_db_id"] for x in d.jobs_table(jobs, stats, weights, LO, HI, sort=sort, limit=100).collect()] and len(set(pages)) == 23
    seen, after = [], None
    while page := d.keyset_page(jobs, after, 4).collect():
        seen += [x["job_db_id"] for x in page]
        after = (page[-1]["job_db_id"], page[-1]["submit_time"])
    assert sorted(seen) == list(range(23))


def test_filters(spark):
    jobs = spark.createDataFrame([job(1, LO, 1), job(2, LO, 1, user=2, state="RUNNING", end=None), job(3, HI, 1)], JOB).withColumn("job_id", F.col("job_db_id"))
    assert js.count_jobs(jobs, job_ids=[]).first()["n"] == 0
    assert js.count_jobs(jobs, job_ids=[1, 3]).first()["n"] == 2
    assert [x["job_db_id"] for x in js.filter_jobs(jobs, state="RUNNING", start=HI).collect()] == [2]
    assert js.count_jobs(jobs, end=LO + H).first()["n"] == 2
    with pytest.raises(ValueError):
        js.common_filters(jobs, cluster_ids=[9], known_clusters=[0])
    with pytest.raises(LookupError):
        js.point_lookup(jobs, "job_db_id", 99)
    with pytest.raises(ValueError):
        js.job_series(jobs, None, None, None, None, ["nothing"])


def test_unused_dimensions_are_not_joined(spark, weights):
    jobs = spark.createDataFrame([job(1, LO, 1)], JOB)
    empty = spark.createDataFrame([], STAT)
    plan = js.job_series(jobs, empty, weights, empty, empty, ["job_db_id", "cpu_cost"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize(("text", "want"), [("h", (3600, 0, True)), ("d", (86400, 0, True)), ("m", (0, 1, True)), ("2d", (172800, 0, False)), ("1m", (2592000, 0, False)), ("3", (259200, 0, False))])
def test_periods(text, want):
    x = ta.parse_period(text)
    assert (x.seconds, x.months, x.calendar) == want


@pytest.mark.parametrize("text", ["", "0d", "x", "-1d", "1y"])
def test_bad_periods(text):
    with pytest.raises(ValueError):
        ta.parse_period(text)


def test_dates_cycles_and_intervals():
    t = date(2024, 3, 10)
    assert ta.date_range(None, None, t) == (date(2024, 3, 9), t)
    assert ta.date_range(date(2024, 3, 5), date(2024, 3, 1), t, (date(2024, 3, 2), date(2024, 3, 3))) == (date(2024, 3, 2), date(2024, 3, 3))
    lo, hi = ta.date_range(date(2024, 3, 1), date(2024, 3, 2), t, (date(2024, 4, 1), date(2024, 4, 2)))
    assert lo == hi
    ends = ta.cycle_ends(date(2024, 3, 10), 4, 3)
    assert ends[0] >= date(2024, 3, 10) and ends[0].weekday() == 0 and ends[0].isocalendar()[1] % 4 == 0 and (ends[0] - ends[2]).days == 56
    assert ta.cycle_ends(date(2020, 12, 27), 1, 1)[0].isocalendar()[1] != 53
    a = datetime(2024, 1, 1, tzinfo=UTC)
    assert len(ta.due_intervals(a, a + 150 * timedelta(minutes=1), 60)) == 2 and len(ta.due_intervals(a, a + H, 0)) == 1


def test_statistics_by_hand(spark):
    vals = [float(i) for i in range(100)] + [math.nan, 2.0**47, 2.0**47 + 3]
    s = sm.metric_statistics(spark.createDataFrame([(1, v) for v in vals] + [(2, 7.0), (3, math.nan)], "k int, value double"), ["k"]).orderBy("k").collect()
    assert [x["k"] for x in s] == [1, 2]
    assert [round(s[0][c], 3) for c in ("mean", "std", "q05", "q25", "median", "q75", "max")] == [49.5, 28.866, 4.95, 24.75, 49.5, 74.25, 99.0]
    assert s[1]["std"] == 0


def test_counter_rates(spark):
    def row(pos, sample, ts, v, **labels):
        return ("k", labels, pos, sample, float(ts), float(v))

    x = [row(0, 0, 0, 0, core="0"), row(0, 1, 10, 20e9, core="0"), row(1, 0, 0, 5e9, core="1"), row(1, 1, 20, 25e9, core="1"), row(2, 0, 20, 40e9, core="0"), row(3, 0, 0, 1e9), row(3, 1, 9, 7e9)]
    got = sm.counter_rates(spark.createDataFrame(x, "name string, labels map<string,string>, series_pos int, sample_pos int, ts_s double, value double"), ["name"])
    assert sorted(r_["value"] for r_ in got.collect()) == [1.0, 2.0, 2.0]  # across chunks of one source; the unlabelled series is left out
    one = spark.createDataFrame([row(0, 0, 0, 1, core="0"), row(1, 0, 5, 2, core="1")], "name string, labels map<string,string>, series_pos int, sample_pos int, ts_s double, value double")
    assert sm.counter_rates(one, ["name"]).count() == 0


def test_memory_without_allocation_is_skipped(spark):
    x = spark.createDataFrame([(i, "memory_rss", {"instance": "a"}, 0, 0, 0.0, 2.0**30) for i in (1, 2, 3)], "job_db_id long, metric string, labels map<string,string>, series_pos int, sample_pos int, ts_s double, value double")
    jobs = spark.createDataFrame([(1, 2048), (2, 0), (3, None)], "job_db_id long, allocated_mem long")
    assert [(r_["job_db_id"], r_["mean"]) for r_ in sm.job_statistics(x, jobs).collect()] == [(1, 0.5)]


ROWS = "user_id long, cluster_id long, end_s double, cost double, waste double, job_db_id long"


def test_ceiling_floors_and_share_cut(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 3600.0 * 100, 3600.0 * 40, 1), (1, 1, 0.0, 3600.0 * 10, 0.0, 2), (2, 0, 0.0, 3600.0 * 50, 3600.0 * 45, 3), (3, 0, 0.0, 0.0, 0.0, 4)], ROWS)
    use = {(x["user_id"], x["cluster_id"]): x for x in uu.user_usage(rows, ceiling=0.6).collect()}
    assert use[1, 0]["wasted"] == pytest.approx(0) and use[1, 0]["true_used"] == pytest.approx(60) and use[3, 0]["user_ratio"] == 0
    assert {x["user_id"] for x in uu.underusers(rows, 40 / 110, 40).collect()} == {1, 2}  # floors count
    cut = uu.cumulative_share_cut(spark.createDataFrame([(0, 1, 60.0), (0, 2, 30.0), (0, 3, 10.0), (1, 9, 5.0)], "cluster_id long, user_id long, wasted double"), 0.7)
    assert {(x["cluster_id"], x["user_id"]) for x in cut.collect()} == {(0, 1), (0, 2), (1, 9)}
    jobs = uu.top_and_bottom_jobs(spark.createDataFrame([(1, 0, 0.0, 10.0, float(w), w) for w in range(5)], ROWS), 2).collect()
    assert {(x["job_db_id"], x["list"]) for x in jobs} == {(4, "worst"), (3, "worst"), (0, "best"), (1, "best")}


def test_escalation_runs(spark):
    flags = spark.createDataFrame([(1, c, f, f) for c, f in enumerate([True, True, False, True])] + [(2, 0, True, True)], "user_id long, cycle int, flagged boolean, isunderuser boolean")
    got = {(x["user_id"], x["cycle"]): x["elevated"] for x in uu.escalated(flags, 4, 2).collect()}
    assert got[1, 0] and not got[1, 1] and not got[1, 3] and not got[2, 0] and len(got) == 8


@pytest.mark.parametrize(("emails", "want"), [(None, {"a", "b", None}), (["a"], {"a"}), (["~a"], {"b", None}), ([], set()), (["a", "b", "~b"], {"a"})])
def test_email_selector(spark, emails, want):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "email string")
    assert {x["email"] for x in df.filter(uu.email_selector(emails)).collect()} == want


def test_time_frames_by_hand(spark):
    at = lambda d, h=0: datetime(2031, 8, d, h)
    x = [(at(1), at(4), "long", 12.0), (at(2, 12), at(3, 12), "half", 8.0), (at(9), None, "open", 5.0), (at(5), at(5), "none", 7.0), (at(4), at(11), "week", 70.0)]
    got = r.time_frames(spark.createDataFrame(x, "start_time timestamp, end_time timestamp, k string, cost double"), ["cost"], start=at(1), size_s=3 * 86400).collect()
    by = {(y["k"], y["timestamp"].day): (round(y["cost"], 6), y["duration"]) for y in got if y["k"] != "none"}
    day = 86400.0
    assert by == {("long", 1): (12.0, 3 * day), ("half", 1): (8.0, day), ("week", 4): (30.0, 3 * day), ("week", 7): (30.0, 3 * day), ("week", 10): (10.0, day)}
    assert [math.isnan(y["cost"]) for y in got if y["k"] == "none"] == [True]


def test_frames_are_closed_on_the_left(spark):
    jobs = spark.createDataFrame([job(1, LO + 24 * H, 0), job(2, LO, 24), job(3, LO + 23 * H, 1)], JOB)
    got = {(x["job_db_id"], x["frame"]) for x in ta.frames_of(jobs, LO, LO + 72 * H, 86400).collect()}
    assert got == {(1, 1), (2, 0), (2, 1), (3, 0), (3, 1)}


N = None


@pytest.mark.parametrize(("inserts", "truncate", "held", "rejected"), [
    ([("a", 0, 5), ("a", 3, 9)], False, {("a", 0, 9)}, set()),  # overlap, equal
    ([("a", 0, 5), ("a", 5, 9)], False, {("a", 0, 9)}, set()),  # touch, equal
    ([("a", 0, 9), ("a", 2, 3)], False, {("a", 0, 9)}, set()),
    ([("a", 0, 2), ("a", 4, 6), ("a", 1, 5)], False, {("a", 0, 6)}, set()),
    ([("a", 0, 5), ("b", 3, 9)], False, {("a", 0, 5)}, {("b", 3, 9)}),
    ([("a", 0, 5), ("b", 1, 3)], False, {("a", 0, 5)}, {("b", 1, 3)}),
    ([("a", 0, 5), ("b", 5, 9)], False, {("a", 0, 5), ("b", 5, 9)}, set()),
    ([("a", 4, 9), ("c", 11, 12), ("b", 1, N)], False, {("b", 1, 4), ("a", 4, 9), ("c", 11, 12)}, set()),
    ([("a", 0, N), ("b", 5, 7)], False, {("a", 0, 5), ("b", 5, 7)}, set()),
    ([("a", 0, N), ("b", 5, N)], False, {("a", 0, 5), ("b", 5, N)}, set()),
    ([("a", 5, N), ("b", 2, N)], False, {("b", 2, 5), ("a", 5, N)}, set()),
    ([("a", N, 5), ("b", 1, 3)], False, {("b", 1, 3), ("a", 3, 5)}, set()),
    ([("a", 4, 9), ("b", 4, N)], False, {("a", 4, 9)}, {("b", 4, N)}),  # nothing would be left of it
    ([("a", 4, N), ("b", 4, 9)], False, {("a", 4, N)}, {("b", 4, 9)}),
    ([("a", 4, N), ("a", 2, N)], False, {("a", 2, N)}, set()),
    ([("a", N, N)], False, {("a", N, N)}, set()),
    ([("a", 2, 4), ("c", 6, 7), ("b", 0, 9)], True, {("b", 0, 2), ("a", 2, 4), ("b", 4, 6), ("c", 6, 7), ("b", 7, 9)}, set()),
    ([("a", 2, 9), ("b", 3, 4)], True, {("a", 2, 9)}, set()),
])
def test_dated_inserts(spark, inserts, truncate, held, rejected):
    num = lambda x: None if x is None else float(x)
    rows = [("k", i, v, num(a), num(b)) for i, (v, a, b) in enumerate(inserts)] + [("other", 0, "z", 1.0, 2.0)]
    got = p.insert_dated(spark.createDataFrame(rows, "key string, seq long, value string, from_s double, to_s double"), "key", truncate).filter("key = 'k'").collect()
    as_set = lambda flag: {(y["value"], y["from_s"], y["to_s"]) for y in got if y["rejected"] is flag}
    assert as_set(False) == {(v, num(a), num(b)) for v, a, b in held} and as_set(True) == {(v, num(a), num(b)) for v, a, b in rejected}


def test_supervisors_in_a_long_chain(spark):
    from tallygrid.plans.intake import checkpoint_dir

    checkpoint_dir(spark)
    persons = spark.createDataFrame([(i,) for i in range(40)], "id long")
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 36)] + [(37, 38), (38, 37), (39, 38)], "user_id long, supervisor long")
    got = {y["id"]: y["level"] for y in p.supervisor_levels(persons, links).collect()}
    assert got == {i: i for i in range(36)} | {36: 0, 37: -1, 38: -1, 39: -1}


def test_identities_levels_and_matches(spark):
    from tallygrid.plans.intake import checkpoint_dir

    checkpoint_dir(spark)
    ids = "record_id long, source string, source_rank int, ids array<struct<source:string,id:string>>, name string, email string"
    x = [(i, "s", i, [("m", f"k{i}"), ("n", f"k{i + 1}"), ("n", f"k{i}")], None if i == 1 else f"n{i}", f"e{i}") for i in range(1, 30)] + [(50, "s", 0, [("m", "z")], "", "e")]
    got = {y["record_id"]: y for y in p.resolve_identities(spark.createDataFrame(x, ids)).collect()}
    assert {got[i]["person_id"] for i in range(1, 30)} == {1} and got[9]["name"] == "n2" and got[9]["conflict"] and not got[50]["valid"]
    persons = spark.createDataFrame([(i,) for i in range(6)], "id long")
    links = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 3), (5, 3)], "user_id long, supervisor long")
    assert {y["id"]: y["level"] for y in p.supervisor_levels(persons, links).collect()} == {0: 0, 1: 1, 2: 2, 3: -1, 4: -1, 5: -1}
    left = spark.createDataFrame([(1, "Éva Roy", "A@x"), (2, "Jean Tremblay", ""), (3, "Sam", "")], "id long, name string, email string")
    right = spark.createDataFrame([(10, "other", "a@X"), (11, "jean trembley", ""), (12, "Sem", ""), (13, "Sum", "")], "id long, name string, email string")
    assert {(y["id"], y["other"], y["by"]) for y in p.match_names(left, right, 2).collect()} == {(1, 10, "email"), (2, 11, "name")}


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_names_match_as_by_brute_force(spark, threshold):
    rng = random.Random(threshold)
    kind = "id long, name string, email string"
    lists = [[(i, "".join(rng.choices("aé bc#", k=rng.randrange(3, 9))), "") for i in range(n)] + [(n, None, "")] for n in (60, 40)]
    known = [{i: Counter(name.translate(str.maketrans("é", "e"))) for i, name, _ in x if name is not None} for x in lists]
    want = set()
    for i, a in known[0].items():
        near = [o for o, b in known[1].items() if sum(abs(a[c] - b[c]) for c in a.keys() | b.keys()) <= threshold]
        want |= {(i, near[0], "name")} if len(near) == 1 else set()
    assert {(y["id"], y["other"], y["by"]) for y in p.match_names(*[spark.createDataFrame(x, kind) for x in lists], threshold).collect()} == want


def test_people_queries_read_whole_tables(spark):
    n = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").count()
    assert intake.j13_supervisor_levels(spark, "/root/testdata/sf0.01").count() == n > 400
    left, _ = intake._two_lists(spark, "/root/testdata/sf0.01")
    assert left.count() == n


def test_supervisor_chain_of_any_depth(spark):
    intake.checkpoint_dir(spark)
    links = spark.createDataFrame([(i + 1, i) for i in range(23)], "user_id long, supervisor long")
    assert {y["id"]: y["level"] for y in p.supervisor_levels(spark.range(24), links).collect()} == {i: i for i in range(24)}


def test_asof_edges(spark):
    dated = spark.createDataFrame([(0, datetime(2024, 1, 2), "a"), (0, datetime(2024, 1, 5), "b")], "c long, since timestamp, v string")
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate([datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 5), None])] + [(9, 7, datetime(2024, 1, 3))], "i long, c long, at timestamp")
    for oldest, first in ((True, "a"), (False, None)):
        assert {y["i"]: y["v"] for y in p.asof(rows, "at", dated, "c", oldest).collect()} == {0: first, 1: "a", 2: "b", 3: "b", 9: None}


def test_gpu_names(spark):
    names = {"n1": {"v100": "$big"}, g.DEFAULTS: {"v100": "volta", "big": "huge", "1g.10gb": g.MIG + "big"}}
    jobs = spark.createDataFrame([(1, ["n1"], "gpu:V100"), (2, ["n1", "n2"], "v100"), (3, [], "V100"), (4, ["n2"], "1g.10gb"), (5, ["n2"], "odd"), (6, ["n1"], None)], "job_db_id long, nodes array<string>, allocated_gpu_type string")
    assert {y["job_db_id"]: y["gpu_name"] for y in g.harmonize(jobs, names).collect()} == {1: "huge", 2: None, 3: "volta", 4: "huge : 1g.10gb", 5: None, 6: None}
    with pytest.raises(ValueError):
        g.flatten_names({g.DEFAULTS: {"bad": g.MIG + "big", "big": "huge"}})


@pytest.mark.parametrize(("text", "want"), [("cn-[001-003,7]", ["cn-001", "cn-002", "cn-003", "cn-7"]), ("a,b[9-11]x", ["a", "b10x", "b11x", "b9x"]), ("None assigned", []), ("", []), (None, [])])
def test_hostlists(spark, text, want):
    df = spark.createDataFrame([(text,)], "h string")
    assert df.select(rec.expand_hostlist(F.col("h")).alias("n")).first()["n"] == want


@pytest.mark.parametrize(("text", "want"), [("50TB", 50 * 10**12), ("13.49 GiB", 14484777205), ("0.00 GiB", 0), ("7", 7), ("x", None), ("5e3", 5000)])
def test_byte_sizes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(rec.byte_size(F.col("t")).alias("b")).first()["b"] == want


def test_names_resolve_through_pointers_and_slices():
    names = {"n": {"x": "$y", "y": "$z", "z": "model z", "r": "$s", "s": "$r", "gone": "$nothing"}, g.DEFAULTS: {"z": "plain z", "1g.10gb": g.MIG + "z", "2g.20gb": g.MIG + "gone", "q": "$1g.10gb"}}
    got = {(node, raw): name for node, raw, name in g.flatten_names(names)}
    assert got == {("n", "x"): "model z", ("n", "y"): "model z", ("n", "z"): "model z", ("n", "1g.10gb"): "model z : 1g.10gb", ("n", "q"): "model z : 1g.10gb", (g.DEFAULTS, "z"): "plain z", (g.DEFAULTS, "1g.10gb"): "plain z : 1g.10gb", (g.DEFAULTS, "q"): "plain z : 1g.10gb"}


def test_comments_do_not_go_on_and_cells_may_be_quoted(spark):
    text = "# old nodes \\\nNodeName=n1 \\\n  Gres=gpu:a:1\n  # x\nNodeName=n2 Gres=gpu:b:2"
    got = {(y["node"], y["gpus"][0]) for y in rec.read_node_gpus(spark.createDataFrame([(text,)], "text string")).collect()}
    assert got == {("n1", "gpu:a:1"), ("n2", "gpu:b:2")}
    lines = spark.createDataFrame([('2030-01-01, 2031-01-01 ,c, "grp, one" ,"say ""so""",5,,,,,,,',), ("",), ("start,end",), ("2030-01-01,2031-01-01,c,r,g",)], "value string")
    clusters = spark.createDataFrame([(1, "c")], "id long, name string")
    assert {(y["resource_name"], y["group_name"], y["cpu_year"]) for y in rec.read_allocations(lines, clusters).collect()} == {("grp, one", 'say "so"', 5), ("r", "g", None)}


def test_pools_have_the_same_statistics_by_ranges(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.gauss(0, 1), 0.0, 1.5, float("nan"), 2.0**47])) for k in ("a", "b") for _ in range(3000)] + [("c", 7.0)]
    x = spark.createDataFrame(rows, "k string, value double")
    both = [{y["k"]: [round(y[c], 9) for c in ("mean", "std", "q05", "q25", "median", "q75", "max")] for y in f(x, ["k"]).collect()} for f in (sm.metric_statistics, sm.pool_statistics)]
    assert both[0] == both[1] and both[0]["c"] == [7, 0, 7, 7, 7, 7, 7]


def test_a_week_without_jobs_is_an_error(spark):
    jobs = spark.createDataFrame([(datetime(2031, 8, d), "u", "x") for d in (4, 18)], "submit_time timestamp, cluster_user string, name string")
    assert r.tool_adoption(jobs, "x", every_week=False).count() == 2
    with pytest.raises(Exception, match="no jobs in the week before 2031-08-18"):
        r.tool_adoption(jobs, "x").collect()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    from tallygrid.functions.folders import shared_folder

    class Bare:
        class sparkContext:
            getConf, getCheckpointDir = staticmethod(lambda: {}), staticmethod(lambda: None)

    Bare.sparkContext.master = master
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Bare)


def test_records_of_a_newer_scheduler_are_an_error(spark):
    raw = spark.createDataFrame([("c", '{"meta":{"slurm":{"version":{"major":"26"}}},"jobs":[{"group":"g","job_id":1}]}')], "cluster string, text string")
    with pytest.raises(Exception, match="unsupported scheduler"):
        rec.read_job_records(raw).collect()


def test_read_texts_and_parts(spark, tmp_path):
    (tmp_path / "a.json").write_text('Banner\n{"meta":{},"jobs":[]}')
    assert rec.read_texts(spark, f"file://{tmp_path}/a.json").first()["text"].startswith("Banner\n{")


def test_late_submissions_are_dropped(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    (tmp_path / "in").mkdir()
    schema = "submit_time timestamp"
    stream = streams.submitted_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src), "1 hour", "2 hours")

    def feed(*hours):
        spark.createDataFrame([(LO + h * H,) for h in hours], schema).coalesce(1).write.mode("append").parquet(src)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    feed(0, 0)
    feed(10)
    feed(0, 20)  # the first is later than the mark allows
    feed(30)
    got = {(y["window_s"] - ta.epoch(LO)) / 3600: y["n_jobs"] for y in spark.read.parquet(out).collect()}
    assert got[0] == 2 and got[10] == 1


TIED = [(1, "v1", None, 900.0), (1, "v0", None, 900.0), (1, "v0", 500.0, None), (1, "v1", 700.0, 800.0), (1, "v0", 500.0, 600.0)]


@pytest.mark.parametrize("turn", range(len(TIED)))
def test_tied_periods_do_not_go_by_the_order_of_rows(spark, turn):
    dated = spark.createDataFrame(TIED[turn:] + TIED[:turn], "user_id long, value string, from_s double, to_s double").coalesce(1)
    periods = dated.select("user_id", "value", F.timestamp_seconds("from_s").alias("valid_from"), F.timestamp_seconds("to_s").alias("valid_to"))
    first = [r["value"] for r in p.check_no_overlap(periods, ["user_id"]).filter("valid_from IS NULL").collect()]
    assert first == ["v1"]


def test_merged_periods_with_ties(spark):
    own = [(0, "v0", None, 806.0), (0, "v1", 816.0, 828.0), (0, "v0", 829.0, 836.0), (0, "v1", 835.0, 840.0)]
    tied = [(3, "v0", None, None), (3, "v0", None, 888.0), (3, "v1", None, 906.0), (3, "v0", 834.0, None), (3, "v1", 836.0, 842.0), (3, "v0", 936.0, None)]
    mapping, found = spark.createDataFrame([(3, 0)], "old_id long, new_id long"), set()
    for rows in (own + tied, own + tied[::-1]):
        dated = spark.createDataFrame(rows, "user_id long, value string, from_s double, to_s double").coalesce(1)
        found.add(str(sorted(map(str, p.merge_periods(dated, mapping, truncate=True).collect()))))
        plan = p.merge_periods(dated, mapping, truncate=True)._jdf.queryExecution().optimizedPlan().toString()
        assert any("row_number" in line and "to_s" in line.split("windowspecdefinition")[1] for line in plan.splitlines() if "windowspecdefinition" in line)
    assert len(found) == 1
