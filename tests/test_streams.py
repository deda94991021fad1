"""Counts with watermarks, bucketed stores and replays: late rows, repeated steps, broken runs."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallygrid.streaming import streams
from tallygrid.streaming.stores import BucketStore, Marks, drops, replay, stored

T0 = datetime(2024, 1, 1)


def hours(*hs):
    return [(i, None if h is None else T0 + timedelta(hours=h)) for i, h in enumerate(hs)]


@pytest.fixture
def counted(spark, tmp_path):
    """Feeds drops of rows (id, submit_time) to one stream, a run for each."""
    def run(*parts, end=None):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, "id long, submit_time timestamp").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/drop={k}")
            query = streams.stream_counts(spark.readStream.schema("id long, submit_time timestamp").parquet(f"{tmp_path}/in/drop=*"), "1 hour", "2 hours", f"{tmp_path}/out", f"{tmp_path}/mark")
            query.awaitTermination()
        table = lambda name: [r.asDict() for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect()]
        return table("counts"), table("late"), table("marks"), query

    return run


def test_late_rows_leave_counts_unchanged(spark, counted, tmp_path):
    start = int(T0.timestamp())
    counts, late, marks, _ = counted(hours(0.5, 0.6, 1.5, 10), hours(0.7, 9.5, None, 20), hours(0.8, 1.9, 17.5, 30), hours(40))
    by_window = {(r["window_s"] - start) // 3600: r["n_jobs"] for r in counts}
    assert len(by_window) == len(counts)  # a window is written once
    assert by_window == {0: 2, 1: 1, 9: 1, 10: 1, 20: 1, 30: 1}
    assert {r["submit_time"] for r in late} == {None, *(T0 + timedelta(hours=h) for h in (0.7, 0.8, 1.9, 17.5))} and len(late) == 5
    assert sum(by_window.values()) + len(late) + 1 == sum(r["n"] for r in marks)  # the newest hour is open, all other rows are counted or late


def test_state_is_bounded(counted):
    *_, query = counted(*[hours(*[24 * day + h for h in range(24)]) for day in range(4)])
    kept = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators]
    assert kept and max(kept) <= 24 + 3  # four days have gone through, one drop and the lateness are kept


def test_repeated_batch_adds_nothing(spark, tmp_path):
    stream = lambda: spark.readStream.schema("id long, submit_time timestamp").parquet(f"{tmp_path}/in/drop=*")
    for k, part in enumerate((hours(0.5, 1.5, 10), hours(0.7, 20))):
        spark.createDataFrame(part, "id long, submit_time timestamp").write.parquet(f"{tmp_path}/in/drop={k}")
        streams.stream_counts(stream(), "1 hour", "2 hours", f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    read = lambda: sorted(str(tuple(r)) for name in ("counts", "late", "marks") for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect())
    before = read()
    newest = max(int(os.path.basename(x)) for x in glob.glob(f"{tmp_path}/mark/commits/[0-9]*"))
    for x in (f"{newest}", f".{newest}.crc"):
        os.remove(f"{tmp_path}/mark/commits/{x}")  # as if the run had been lost before it could note that the batch was done
    streams.stream_counts(stream(), "1 hour", "2 hours", f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert read() == before


def store_rows(store):
    return sorted(tuple(r) for r in store.load().collect())


def test_store_writes_touched_buckets_only(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s", ["k"], "v", buckets=16)
    assert store.load() is None and store.index() == {}
    assert len(store.write(spark.range(5000).selectExpr("id AS k", "1L AS v", "'x' AS text"), 0)) == 16
    touched = store.write(spark.createDataFrame([(7, 2, "new"), (8, 0, "old")], "k long, v long, text string"), 1)
    assert 1 <= len(touched) <= 2 and {os.path.basename(p) for p in glob.glob(f"{tmp_path}/s/data/step=1/bucket=*")} == {f"bucket={b}" for b in touched}
    assert store_rows(store) == sorted([(k, 1, "x") for k in range(5000) if k != 7] + [(7, 2, "new")])
    size = lambda step: sum(os.path.getsize(p) for p in glob.glob(f"{tmp_path}/s/data/step={step}/*/*.parquet"))
    assert size(1) < size(0) / 4
    assert store.outdated(0) == [] and len(store.outdated(1)) == len(touched)


def test_store_step_repeats_and_is_seen_whole(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s", ["k"], buckets=4)
    one = spark.createDataFrame([(k, "a") for k in range(40)], "k long, text string")
    store.write(one, 0)
    two = spark.createDataFrame([(k, "b") for k in range(0, 80, 2)], "k long, text string")
    store.write(two, 1)
    want = sorted([(k, "b") for k in range(0, 80, 2)] + [(k, "a") for k in range(1, 40, 2)])
    assert store_rows(store) == want
    store.write(two, 1)
    assert store_rows(store) == want
    two.withColumn("bucket", store.bucket()).write.partitionBy("bucket").parquet(f"{tmp_path}/s/data/step=2")  # lost before its index
    assert store_rows(store) == want
    assert store.write(two.limit(0), 3) == [] and store_rows(store) == want


def test_store_handles_null_keys_and_repeats(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s", ["a", "b"], "v", buckets=3)
    rows = [(None, "x", 1), (None, "x", 3), (1, None, 2), (1, None, None)]
    store.write(spark.createDataFrame(rows, "a long, b string, v long"), 5)
    assert {tuple(r) for r in store.load().collect()} == {(None, "x", 3), (1, None, 2)}


def test_statistics_stream_rewrites_its_buckets(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s", ["job", "name"], buckets=64)
    for k, rows in enumerate(([(j, "m", float(x)) for j in range(100) for x in range(4)], [(3, "m", 10.0), (3, "m", 20.0)])):
        spark.createDataFrame(rows, "job long, name string, value double").write.parquet(f"{tmp_path}/in/d={k}")
        streams.stream_statistics(spark.readStream.schema("job long, name string, value double").parquet(f"{tmp_path}/in/d=*"), store, f"{tmp_path}/mark").awaitTermination()
    got = {r["job"]: r["mean"] for r in store.load().collect()}
    assert len(got) == 100 and got[3] == 15.0 and got[4] == 1.5
    assert len(glob.glob(f"{tmp_path}/s/data/step=1/bucket=*")) == 1


def test_replay_takes_up_a_broken_drop(spark, tmp_path):
    rows = spark.createDataFrame([(i, T0 + timedelta(days=i // 3)) for i in range(12)], "id long, ts timestamp")
    marks, seen, fail = Marks(spark, f"{tmp_path}/marks"), [], [True]
    assert marks.get("jobs") is None

    def step(drop, at):
        if at == T0 + timedelta(days=2) and fail:
            fail.clear()
            raise ConnectionError
        seen.append((at, drop.count()))

    with pytest.raises(ConnectionError):
        replay(rows, "jobs", marks, step)
    assert marks.get("jobs") == T0 + timedelta(days=1) and marks.get("other") is None
    assert replay(rows, "jobs", marks, step) == [T0 + timedelta(days=2), T0 + timedelta(days=3)]
    assert seen == [(T0 + timedelta(days=d), 3) for d in range(4)] and replay(rows, "jobs", marks, step) == []
    assert [at for at, _ in drops(rows, F.col("ts"), T0 + timedelta(days=2))] == [T0 + timedelta(days=3)]


def test_replay_keeps_the_mark_before_errors(spark, tmp_path):
    rows = spark.createDataFrame([(i, T0 + timedelta(days=i)) for i in range(4)] + [(9, None)], "id long, ts timestamp")
    marks, bad = Marks(spark, f"{tmp_path}/marks"), {T0 + timedelta(days=1)}
    assert replay(rows, "metrics", marks, lambda drop, at: at not in bad) == [T0]
    assert marks.get("metrics") == T0  # later drops were read, the mark waits for the one with errors
    bad.clear()
    assert replay(rows, "metrics", marks, lambda drop, at: None) == [T0 + timedelta(days=d) for d in (1, 2, 3)]


def test_nothing_stored_is_none_and_other_errors_are_not(spark, tmp_path):
    assert stored(spark, f"{tmp_path}/none") is None
    with pytest.raises(Exception, match="PARSE|syntax|mismatched"):
        stored(spark, f"{tmp_path}/none", "a b c d,,")


def test_replayed_drops_go_by_the_nearest_second_as_the_sql_does(spark, tmp_path):
    import duckdb

    from tallygrid.plans import intake

    edge = datetime(2024, 1, 8)
    at = [edge + timedelta(microseconds=k) for k in (-600_000, -500_001, -500_000, -499_999, -1, 0, 1, 400_000)]
    rows = spark.createDataFrame([(k % 3, t) for k, t in enumerate(at)], "user_id long, ts timestamp").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, intake.s9_replay(spark, str(tmp_path)).collect())) == sorted(c.execute(intake.SQL["s9_replay"]).fetchall())


def test_few_large_documents_are_read_at_once(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from tallygrid.plans import intake

    monkeypatch.setattr(intake, "DOCUMENTS_PER_FILE", 1)
    monkeypatch.setattr(intake, "checkpoint_dir", lambda _, k=iter("abc"): f"{tmp_path}/{next(k)}")
    assert intake.t1_stream_job_records(spark, "/root/testdata/sf0.001").count() > 0
    files = glob.glob(f"{tmp_path}/a/day=*/*.parquet")
    assert files and all(pq.read_metadata(f).num_rows <= 1 for f in files)
