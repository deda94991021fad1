"""Streams over the batch operators: drops into jobs, samples into statistics, submissions into counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.operators.samples import metric_statistics
from tallygrid.sources.records import read_job_records, upsert
from tallygrid.streaming.stores import BucketStore, stored


def _each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(stream: DataFrame, keys: list[str], order: str, path: str, part: Column, checkpoint: str):
    """Keep the newest row of each key in a Parquet table at ``path``, partitioned by ``part``, a function of the key; the checkpoint is the mark of what has been read.

    A micro-batch reads and rewrites only the partitions that it has rows of. A repeated batch changes nothing, so a lost run can be taken up again.
    """
    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("part", part).persist(StorageLevel.DISK_ONLY)  # documents are parsed once, and rows take no memory
        try:
            touched = [r["part"] for r in batch.select("part").distinct().collect()]  # partitions, not keys
            if not touched:
                return
            old = stored(spark, path, batch.schema)
            old = batch.limit(0) if old is None else old.filter(F.col("part").isin(touched))
            upsert(old, batch, keys, order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        finally:
            batch.unpersist()

    return _each_batch(stream, step, checkpoint)


def stream_job_records(raw: DataFrame, keys: list[str], order: str, path: str, part: Column, checkpoint: str):
    """Scheduler documents (text, cluster, ``order``) as they are dropped, read into job rows (:func:`tallygrid.sources.records.read_job_records`), the newest of each key kept.

    Parquet is read in batches of up to 4096 rows, so drops of large documents should have few in each file (``maxRecordsPerFile``).
    """
    return stream_latest(read_job_records(raw, order), keys, order, path, part, checkpoint)


def stream_statistics(stream: DataFrame, store: BucketStore, checkpoint: str, statistics: Callable[[DataFrame], DataFrame] | None = None):
    """Statistics (default: of each key's values) of the samples in each micro-batch in place of stored ones of the same keys: a finished job's samples come in one drop, so no state is kept.

    A micro-batch reads and writes the buckets of ``store`` that its keys fall into; a repeated one replaces what it wrote before.
    """
    def step(batch: DataFrame, number: int) -> None:
        store.write(statistics(batch) if statistics else metric_statistics(batch, store.keys), number)

    return _each_batch(stream, step, checkpoint)


def submitted_counts(stream: DataFrame, length: str, lateness: str, column: str = "submit_time") -> DataFrame:
    """Jobs submitted per window of event time. Works on streams, where rows of windows that ended ``lateness`` or more before the newest row are dropped (:func:`stream_counts` keeps them), and on tables."""
    return stream.withWatermark(column, lateness).groupBy(F.window(column, length)).agg(F.count("*").alias("n_jobs")).select(F.unix_timestamp("window.start").alias("window_s"), "n_jobs")


def stream_counts(stream: DataFrame, length: str, lateness: str, path: str, checkpoint: str, column: str = "submit_time"):
    """Jobs per window of event time: each window is written once, when the watermark passes its end, and then leaves the state; late rows go to a table of their own.

    Three tables by micro-batch under ``path``: ``counts`` (window_s, n_jobs: windows closed by it), ``late`` (all columns: rows of windows that were closed before, or without a time) and ``marks`` (newest
    time, rows). A micro-batch that is repeated replaces its own part of each, so it adds nothing. Counts and rows are two branches of one query over one
    source, so they see the same rows and the same watermark, and every row is either counted or late. What is kept in memory and state is the open windows, as many as ``lateness`` and the width of the newest micro-batch span.
    """
    timed = stream.withWatermark(column, lateness)
    kept = F.struct(*[F.col(f"`{c}`") for c in stream.columns])
    counts = timed.groupBy(F.window(column, length).alias("w")).agg(F.count("*").alias("n_jobs"))
    schema = stream.select(kept.alias("row")).schema["row"].dataType
    counts = counts.select(F.unix_timestamp("w.start").alias("window_s"), "n_jobs", F.lit(None).cast(schema).alias("row"))
    rows = timed.select(F.lit(None).cast("long").alias("window_s"), F.lit(None).cast("long").alias("n_jobs"), kept.alias("row"))
    back = F.expr(f"INTERVAL {lateness}")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # state is read and written once
        try:
            batch.filter("row IS NULL").select("window_s", "n_jobs").write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
            own = batch.filter("row IS NOT NULL").select("row.*")
            marks = stored(spark, f"{path}/marks", "newest timestamp, n long, batch long")
            # windows closed by earlier micro-batches: the one before this closed those that ended by the watermark it began with
            newest = None if marks is None else marks.filter(F.col("batch") < number - 1).agg(F.max("newest")).first()[0]
            time, end = F.col(f"`{column}`"), F.col("__window.end")
            closed = F.lit(False) if newest is None else end <= F.date_trunc("millisecond", F.lit(newest)) - back
            placed = own.filter(time.isNotNull()).withColumn("__window", F.window(f"`{column}`", length))
            late = placed.filter(closed | (end <= F.timestamp_seconds(F.lit(0)))).drop("__window").unionByName(own.filter(time.isNull()))
            late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            own.agg(F.max(time).cast("timestamp").alias("newest"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        finally:
            batch.unpersist()

    return counts.unionByName(rows).writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
