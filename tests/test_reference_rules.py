"""Rules that the tables of the queries do not reach: brackets, scripts, default ranges, markers, labels, hooks, hot groups."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import gpunames as g, ranges
from tallygrid.operators import people as p, underuse as uu
from tallygrid.sources import records as rec, users as usr

T0 = datetime(2024, 1, 1)

HOSTS = {
    "r[1-2]n[1-2]": ["r1n1", "r1n2", "r2n1", "r2n2"], "a[1,3]b[x,y]c[08-10]-ib": [f"a{i}b{j}c{k}-ib" for i in "13" for j in "xy" for k in ("08", "09", "10")],
    "cn-[001-003,7]x,gpu1": ["cn-001x", "cn-002x", "cn-003x", "cn-7x", "gpu1"], "a,a,a[1],a1": ["a", "a1"], "[1-3]": ["1", "2", "3"], "n[9-11],m": ["m", "n10", "n11", "n9"],
    "": [], "None assigned": [], None: [], "plain": ["plain"], "x[1][2]y,z[5]": ["x12y", "z5"],
}


def test_host_lists_with_any_brackets(spark):
    got = spark.createDataFrame([(k, k) for k in HOSTS], "k string, nodes string").select("k", rec.expand_hostlist(F.col("nodes")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {k: sorted(v) for k, v in HOSTS.items()}


@pytest.mark.parametrize("text, want", [("a[1,,2]b", ["a1b", "a2b", "ab"]), ("a[[1,x[2]", ["a[1", "ax[2"]), ("a[]b", ["ab"]), ("a[10-8]", ["a08", "a09", "a10"]), ("a[x-y]", None), ("a[+1-2]", None)])
def test_odd_brackets(spark, text, want):
    assert spark.createDataFrame([(text,)], "h string").select(rec.expand_hostlist(F.col("h")).alias("n")).first()["n"] == want


def test_choices_of_brackets_are_made_before_their_product(spark):
    plan = spark.range(1).select(rec.expand_hostlist(F.concat(F.lit("n[1-2]"), F.col("id"))))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(transform(" in plan
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_scheduler_documents_are_parsed_once(spark):
    raw = spark.createDataFrame([("c", '{"jobs": [{"job_id": 1, "group": "g"}]}'), ("c", "no json"), ("c", None)], "cluster string, text string")
    rows = rec.read_job_records(raw)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and [r["job_id"] for r in rows.collect()] == [1]
    new = raw.limit(0).unionByName(spark.createDataFrame([("c", '{"meta": {"Slurm": {"version": {"major": "99"}}}, "jobs": []}')], "cluster string, text string"))
    with pytest.raises(Exception, match="unsupported scheduler version 99"):
        rec.read_job_records(new).collect()


def test_user_search_without_a_range_is_now(spark):
    users = spark.createDataFrame([(k, f"u{k}", "e") for k in range(4)], "id long, display_name string, email string")
    day = timedelta(days=1)
    types = spark.createDataFrame([(0, "phd", None, None), (1, "phd", T0 - day, T0 + day), (2, "phd", None, T0), (3, "phd", T0 + day, None)], "user_id long, member_type string, valid_from timestamp, valid_to timestamp")
    found = lambda **how: {r["id"] for r in p.find_users(users, types, member_type="phd", **how).collect()}
    assert found(now=T0) == {0, 1} and found(now=T0 + 2 * day) == {0, 3} and found(lo=T0) == {0, 1, 3} and found(hi=T0) == {0, 1, 2}
    assert found(lo=T0 - day, hi=T0 + 2 * day) == {0, 1, 2, 3}
    assert found() == {0, 3} or datetime.now(timezone.utc).year < 2024


def bag_distance(a, b):
    fold = str.maketrans("éèëêçîï", "eeeecii")
    a, b = (x.lower().translate(fold) for x in (a, b))
    return sum(abs(a.count(c) - b.count(c)) for c in set(a + b))


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 5])
def test_names_of_any_script(spark, threshold):
    rng = random.Random(threshold)
    parts = ["Анна", "Иван", "Кузнецов", "王小明", "李雷", "Νίκος", "Éric", "Zoë", "d'Arc", "Lee", "ليلى", "😀"]
    name = lambda: " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    typo = lambda x: "".join(c for i, c in enumerate(x) if rng.random() > 0.08) + rng.choice(["", "", "x", "я", "明"])
    left = [(i, name(), None) for i in range(60)] + [(60, "", None), (61, None, None)]
    right = [(i, typo(rng.choice(left[:60])[1]), None) for i in range(60)] + [(60, "", None), (61, None, None)]
    make = lambda rows: spark.createDataFrame(rows, "id long, name string, email string")
    got = [tuple(r) for r in p.nearest_names(make(left), make(right), threshold, 10).collect()]
    want = []
    for i, a, _ in left:
        near = sorted((bag_distance(a, b), b.encode("utf-8"), j) for j, b, _ in right if a is not None and b is not None and bag_distance(a, b) <= threshold)
        want += [(i, j, d, k) for k, (d, _, j) in enumerate(near[:10], 1)]
    assert sorted(got) == sorted(want) and (threshold == 0 or len(want) > 20)
    alone = {i for i in range(62) if sum(w[0] == i for w in want) == 1}
    assert {(r["id"], r["by"]) for r in p.match_names(make(left), make(right), threshold).collect()} == {(i, "name") for i in alone}


def test_unlike_scripts_are_far_apart(spark):
    one = lambda name: spark.createDataFrame([(1, name, None)], "id long, name string, email string")
    for a, b in (("王小明", "李雷雷"), ("Анна", "王小")):
        assert p.match_names(one(a), one(b), 1).count() == 0


def test_five_markers(spark):
    cases = [(None, None, None, ""), (False, False, False, "✓"), (True, False, False, "▲"), (True, True, False, "⚑▲"), (True, True, True, "!!⚑▲"), (False, True, True, "✓")]
    df = spark.createDataFrame(cases, "u boolean, f boolean, e boolean, want string")
    assert all(r["m"] == r["want"] for r in df.select("want", uu.marker(*map(F.col, "ufe")).alias("m")).collect())


def test_recurring_flags_per_cycle_and_export(spark, tmp_path):
    rows = [(c, 1, 0, 100.0, 60.0, 0.4, True, c < 3) for c in range(1, 5)] + [(2, 2, 0, 10.0, 1.0, 0.9, False, False)]
    classified = spark.createDataFrame(rows, "cycle int, user_id long, cluster_id long, rgu_hours double, wasted double, sm_occ_mean double, isunderuser boolean, flagged boolean")
    out = {r["user_id"]: r for r in uu.recurring_underusers(classified, 3, 5, 2, future=1).collect()}
    assert [out[1][f"c{i}"] for i in range(5)] == [None, True, True, True, True] and [out[1][f"f{i}"] for i in range(5)] == [None, True, True, False, False]
    assert [out[1][f"e{i}"] for i in range(5)] == [None, True, False, False, False] and out[1]["cluster_share"] == pytest.approx(120 / 121)
    table = uu.recurring_table(uu.recurring_underusers(classified, 3, 5, 2, future=1), 5, 3, "https://x")
    uu.export_recurring(table, f"{tmp_path}/csv")
    lines = [x for f in sorted((tmp_path / "csv").glob("part*")) for x in f.read_text("utf-8").splitlines()]
    assert lines[1].endswith(",,!!⚑▲,⚑▲,,▲,▲") and lines[1].startswith("0,1,")


@pytest.mark.parametrize("keep", [None, "user_rgu_hours > 50"])
def test_usage_filter_sees_users_over_all_clusters(spark, keep):
    rows = spark.createDataFrame([(1, 0, 3600.0 * 30, 0.0), (1, 1, 3600.0 * 30, 0.0), (2, 0, 3600.0 * 40, 0.0)], "user_id long, cluster_id long, cost double, waste double")
    assert {(r["user_id"], r["cluster_id"]) for r in uu.user_usage(rows, keep=keep if keep is None else F.expr(keep)).collect()} == ({(1, 0), (1, 1)} if keep is not None else {(1, 0), (1, 1), (2, 0)})


def test_labels_win_over_nodes_and_are_harmonized(spark):
    jobs = spark.createDataFrame([(k, ["n1"], 1 if k < 5 else None, "V100") for k in range(6)], "job_db_id long, nodes array<string>, allocated_gres_gpu int, allocated_gpu_type string")
    nodes = spark.createDataFrame([(k, {"n1": ["A100"]}) for k in (0, 1, 5)], "job_db_id long, node_to_gpu map<string, array<string>>")
    labels = spark.createDataFrame([(1, "H100"), (2, "H100"), (3, None), (5, "H100")], "job_db_id long, gpu_type string")
    names = {"n1": {"v100": "volta-32"}, g.DEFAULTS: {"a100": "ampere", "h100": "hopper", "v100": "volta"}}
    got = {r["job_db_id"]: (r["inferred_gpu_type"], r["gpu_name"]) for r in g.infer_gpu_type(jobs, nodes, names, labels).collect()}
    assert got == {0: ("A100", "ampere"), 1: ("H100", "hopper"), 2: ("H100", "hopper"), 3: ("V100", "volta-32"), 4: ("V100", "volta-32"), 5: ("V100", "volta-32")}


def test_directory_entries_without_the_flag_are_active(spark):
    raw = spark.createDataFrame([('[{"displayName": ["A"], "mail": ["A@x"], "posixUid": ["a"]}, {"displayName": ["B"], "mail": ["b@x"], "posixUid": ["b"], "suspended": ["true"]}]',)], "text string")
    got = usr.read_directory(raw, spark.createDataFrame([("zz",)], "username string"), T0, "home").collect()
    assert [r["own_id"] for r in got] == ["a@x"] and got[0]["accounts"][0]["valid_to"] is None


def test_patches_change_records_in_order(spark):
    raw = spark.createDataFrame([('{"m1": [{"name": "directory", "mid": "u1"}]}',)], "text string")
    first, second = (lambda df: df.withColumn("name", F.lit("one")), lambda df: df.withColumn("name", F.concat("name", F.lit(" two"))))
    assert [r["name"] for r in usr.read_users([("manual", raw, {})], [first, second]).collect()] == ["one two"]


def test_running_sums_of_a_hot_group_and_pages(spark):
    rng = random.Random(2)
    rows = [(0 if i % 3 else rng.randrange(5), rng.randrange(200), i) for i in range(3000)] + [(None, 7, 10_000), (None, None, 10_001)]
    df = spark.createDataFrame(rows, "cluster_id long, v long, user_id long").repartition(5)
    got = {r["user_id"]: r["upto"] for r in ranges.running_sum(df, ["cluster_id"], [F.col("v").desc(), F.col("user_id")], "v", "upto").collect()}
    want, so_far = {}, {}
    for c, v, i in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1), r[2])):
        so_far[c] = so_far.get(c, 0) + (v or 0)
        want[i] = so_far[c]
    assert got == want
    totals = {(r["cluster_id"], r["t"]) for r in ranges.with_total(df, ["cluster_id"], "v", "t").collect()}
    assert totals == {(c, sum(v or 0 for x, v, _ in rows if x == c)) for c, _, _ in rows}


@pytest.mark.parametrize("offset", [0, 990, 1000, 2500, 2995, 5000])
def test_deep_pages_are_one_order(spark, monkeypatch, offset):
    monkeypatch.setattr(ranges, "SHALLOW", 1000)
    rows = [(i, (i * 7919) % 500) for i in range(3000)]
    page = ranges.page_of(spark.createDataFrame(rows, "id long, v long").repartition(6), [F.col("v").desc(), F.col("id")], offset, 20, "at").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[offset : offset + 20]
    assert sorted((r["at"], r["id"]) for r in page) == [(offset + k, r[0]) for k, r in enumerate(want, 1)]


@pytest.mark.parametrize("oldest_before", [True, False])
def test_asof_by_slots_is_the_latest_before(spark, oldest_before):
    rng = random.Random(6)
    dated = [(k, T0 + timedelta(hours=h), f"{k}/{h}") for k in range(3) for h in rng.sample(range(0, 9000), [1, 5, 400][k])]
    rows = [(i, rng.choice([0, 1, 2, 9, None]), None if i % 17 == 0 else T0 + timedelta(hours=rng.randrange(-500, 9500))) for i in range(900)] + [(1000 + k, d[0], d[1]) for k, d in enumerate(dated[:50])]
    found = p.asof(spark.createDataFrame(rows, "id long, key long, t timestamp"), "t", spark.createDataFrame(dated, "key long, since timestamp, version string"), "key", oldest_before)
    got = {r["id"]: r["version"] for r in found.collect()}
    assert len(got) == found.count() == len(rows)
    for i, key, t in rows:
        own = sorted((since, v) for k, since, v in dated if k == key)
        hit = own[-1:] if t is None else [x for x in own if x[0] <= t][-1:] or (own[:1] if oldest_before else [])
        assert got[i] == (hit[0][1] if hit else None), (i, key, t)


def test_entries_that_lack_fields_are_reported(spark):
    raw = spark.createDataFrame([('[{"displayName": ["A"], "posixUid": ["a"], "suspended": ["false"]}, {"mail": ["B@x"], "posixUid": [], "suspended": ["false"]}]',)], "text string")
    hr = spark.createDataFrame([("m1", "N", "", "p", "a", "2020-01-01", None, ["m2"]), ("m2", "N", "Z@x", "q", "q", "bad", None, None)], "member_no string, name string, email string, profile string, affiliation string, start string, end string, supervisors array<string>")
    sources = [
        ("directory", raw, {"open_accounts": spark.createDataFrame([], "username string"), "at": T0, "domain": "home"}), ("hr", hr, {"member_types": {("p", "a"): "phd"}, "blocked": []}),
        ("manual", spark.createDataFrame([('{"m": [{"name": "hr", "mid": "m2"}]}',)], "text string"), {}),
    ]
    got = {(r["source"], r["entry"], r["field"]) for r in usr.missing_fields(sources).collect()}
    assert got == {("directory", "a", "own_id"), ("directory", "B@x", "username"), ("hr", "m1", "email"), ("hr", "m2", "type"), ("hr", "m2", "start"), ("manual", "m", "ids")}
    users = usr.read_users(sources)
    assert {(r["source"], r["own_id"]) for r in users.collect()} == {("directory", "b@x"), ("hr", "m2"), ("manual", "m")}
    assert [f"{f.name} {f.dataType.simpleString()}" for f in users.schema][:8] == usr.RECORD.split(", missing")[0].split(", ")
    with pytest.raises(ValueError, match="hr"):
        usr.register_reader("hr", usr.read_hr_rows)


def test_files_reach_their_days_byte_for_byte(spark, tmp_path):
    rng = random.Random(1)
    bodies = {f"x-2024-0{m}-{d:02d}-{k}.bin": rng.randbytes(rng.randrange(3000)) for m in (1, 2) for d in (3, 14) for k in range(3)} | {"readme": b"no date", "empty-2024-01-03": b""}
    for name, body in bodies.items():
        (tmp_path / "in" / str(len(name) % 2)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(len(name) % 2) / name).write_bytes(body)
    for _ in range(2):  # a repeated run leaves the same
        left = rec.dispatch_drops(spark, f"{tmp_path}/in", f"{tmp_path}/out")
        assert [(r["name"], r["length"]) for r in left.collect()] == [("readme", 7)]
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        assert {r["name"]: bytes(r["content"]) for r in rows} == {k: v for k, v in bodies.items() if k.startswith("x")} and len(rows) == 12
    assert (tmp_path / "out" / "year=2024" / "month=2" / "day=14").is_dir() or (tmp_path / "out" / "year=2024" / "month=02" / "day=14").is_dir()


def test_incremental_identities_equal_a_full_resolution(spark):
    rng = random.Random(8)
    every = [(i, [("s", f"k{rng.randrange(90)}") for _ in range(rng.randrange(1, 4))]) for i in range(120)]
    schema = "record_id long, ids array<struct<source:string,id:string>>"
    full = spark.createDataFrame([(i, ids, 0, "n", "e") for i, ids in every], f"{schema}, source_rank int, name string, email string")
    person = {r["record_id"]: r["person_id"] for r in p.resolve_identities(full).collect()}
    old, new = every[:90], every[90:]
    first = p.resolve_identities(full.filter("record_id < 90")).select("person_id", "record_id").checkpoint()
    ids = first.join(full, "record_id").select("person_id", F.explode("ids").alias("x")).select("person_id", "x.source", "x.id").distinct()
    assigned, merged = p.resolve_against(ids, spark.createDataFrame(new, schema))
    moved = {r["record_id"]: (False, r["person_id"]) for r in p.remap_owners(first, merged, "person_id").collect()} | {r["record_id"]: (r["is_new"], r["person_id"]) for r in assigned.collect()}
    assert moved.keys() == person.keys() and merged.count() > 0 and old
    for a in moved:
        for b in moved:
            assert (moved[a] == moved[b]) == (person[a] == person[b]), (a, b)
    touched = {k for _, x in new for k in x}
    assert {r["old_id"] for r in merged.collect()} <= {r["person_id"] for r in ids.collect() if (r["source"], r["id"]) in touched}


def test_dated_fields_of_a_person_are_one(spark):
    types = "types array<struct<value:string,valid_from:timestamp,valid_to:timestamp>>"
    d = lambda n: T0 + timedelta(days=n)
    records = spark.createDataFrame([(1, 1, [("b", d(0), d(30))]), (2, 0, [("a", d(10), d(20))]), (3, 0, [("c", d(0), d(5)), ("a", d(20), d(25))])], f"record_id long, source_rank int, {types}")
    persons = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "record_id long, person_id long")
    day = lambda s: round((s - d(0).replace(tzinfo=timezone.utc).timestamp()) / 86400)
    for truncate, want in ((True, {(7, "a", 10, 20, False), (7, "b", 0, 10, False), (7, "b", 20, 30, False)}), (False, {(7, "a", 10, 20, False), (7, "b", 0, 30, True)})):
        got = {(r["person_id"], r["value"], day(r["from_s"]), day(r["to_s"]), r["rejected"]) for r in p.merge_dated(records, persons, F.col("types"), truncate).collect()}
        assert got == want | {(8, "c", 0, 5, False), (8, "a", 20, 25, False)}


@pytest.mark.parametrize("truncate", [False, True])
def test_islands_of_a_large_key_equal_the_fold(spark, monkeypatch, truncate):
    rng = random.Random(3)
    rows = []
    for seq in range(3000):  # islands of a few days, some touch, a few open ends late in time
        a = rng.randrange(400) * 10.0 + rng.randrange(6)
        b = None if a > 3950 and rng.random() < 0.1 else a + rng.randrange(1, 5)
        rows.append((rng.choice([1, 1, 1, 2, None]), seq, rng.choice("xyz"), a, b))
    df = spark.createDataFrame(rows, "k long, seq long, value string, from_s double, to_s double").repartition(5)
    found = []
    for large in (10_000, 100):
        monkeypatch.setattr(p, "LARGE_KEY", large)
        found.append(sorted(map(str, p.insert_dated(df, "k", truncate).collect())))
    assert found[0] == found[1] and len(found[0]) > 500
    cut = p._islands(df.select("k", F.struct("seq", F.col("from_s").alias("a"), F.coalesce("to_s", F.lit(1e18)).alias("b"), F.col("value").alias("v")).alias("i")), "k")
    assert cut.filter("k = 1").select("island").distinct().count() > 200


def test_only_letters_within_a_small_threshold_meet(spark):
    a = spark.createDataFrame([(list("aabc"),), (list("abc"),), ([],)], "c array<string>")
    found = p.near_letters(a, a.withColumnRenamed("c", "d"), 2)
    assert not any("Join" in line and "array_except" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert sorted(("".join(r["c"]), "".join(r["d"]), r["distance"]) for r in found.collect()) == [("", "", 0), ("aabc", "aabc", 0), ("aabc", "abc", 1), ("abc", "aabc", 1), ("abc", "abc", 0)]
