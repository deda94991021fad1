"""Tables that runs and micro-batches write step by step: a bucketed store by key, and marks of what has been read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrid.sources.records import upsert


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None if nothing has been written there yet."""
    try:
        found = (spark.read.schema(schema) if schema else spark.read).parquet(path)
        found.schema  # noqa: B018  a client that plans lazily notices here
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return found


class BucketStore:
    """The newest row of each key in a Parquet table, in ``buckets`` buckets of a hash of the key.

    A step (a micro-batch or a run, numbered upwards) reads and writes only the buckets that its rows fall into, as ``data/step=S/bucket=B``; then a small index (a row per
    bucket: the step that wrote it last) is written as ``index/step=S``, which makes the step count. Readers take the newest index, so they see a step as a whole or not at all.
    A step that is repeated starts from the index before it and replaces what it left: nothing is counted twice. Folders that no kept index names may be deleted (:meth:`outdated`).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def index(self, before: int | None = None) -> dict[int, int]:
        """The step that wrote each bucket last, of the newest step (below ``before``): at most ``buckets`` rows."""
        found = stored(self.spark, f"{self.path}/index", "bucket int, wrote long, step long")
        if found is None:
            return {}
        found = found if before is None else found.filter(F.col("step") < before)
        newest = found.agg(F.max("step")).first()[0]
        return {} if newest is None else {r["bucket"]: r["wrote"] for r in found.filter(F.col("step") == newest).collect()}

    def _read(self, schema: str, index: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/step={s}/bucket={b}" for b, s in sorted(index.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).drop("step", "bucket") if paths else None

    def load(self, schema: str | None = None) -> DataFrame | None:
        """All rows, or None if no step has been written."""
        index = self.index()
        if not index:
            return None
        return self._read(schema or self.spark.read.parquet(f"{self.path}/data/step={next(iter(index.values()))}").drop("bucket").schema, index)

    def write(self, fresh: DataFrame, step: int) -> list[int]:
        """Put ``fresh`` in place of stored rows of the same keys (by ``order`` if there is one: the greater wins, the fresh one among equals); returns the buckets that were touched.

        Without an order a key should be once in ``fresh``; of several rows one stays.
        """
        dealt = fresh.withColumn("bucket", self.bucket()).persist()
        try:
            touched = sorted(r["bucket"] for r in dealt.select("bucket").distinct().collect())
            if not touched:
                return []
            index = self.index(before=step)
            old = self._read(fresh.schema, {b: index[b] for b in touched if b in index})
            new = dealt.drop("bucket")
            both = new.limit(0) if old is None else old
            order = F.lit(0) if self.order is None else F.col(self.order)
            rows = upsert(both.withColumn("__order", order), new.withColumn("__order", order), self.keys, "__order").drop("__order")
            rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/step={step}")
        finally:
            dealt.unpersist()
        index |= dict.fromkeys(touched, step)
        table = self.spark.createDataFrame(sorted(index.items()), "bucket int, wrote long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/step={step}")
        return touched

    def outdated(self, keep: int) -> list[str]:
        """Folders of buckets that neither the newest index nor any of step ``keep`` or later names."""
        found = stored(self.spark, f"{self.path}/index", "bucket int, wrote long, step long")
        if found is None:
            return []
        newest = found.agg(F.max("step")).first()[0]
        live = {(r["bucket"], r["wrote"]) for r in found.filter((F.col("step") >= keep) | (F.col("step") == newest)).select("bucket", "wrote").distinct().collect()}
        every = {(r["bucket"], r["wrote"]) for r in found.select("bucket", "wrote").distinct().collect()}
        return [f"{self.path}/data/step={s}/bucket={b}" for b, s in sorted(every - live)]


class Marks:
    """How far each source has been read: an append-only ledger of (source, at, moved). A mark moves by one small file, so it moves as a whole or not at all; the greatest counts."""

    SCHEMA = "source string, at timestamp, moved timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def get(self, source: str) -> datetime | None:
        found = stored(self.spark, self.path, self.SCHEMA)
        return None if found is None else found.filter(F.col("source") == source).agg(F.max("at")).first()[0]

    def move(self, source: str, at: datetime) -> None:
        row = self.spark.createDataFrame([(source, at)], "source string, at timestamp").withColumn("moved", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self.path)


def drops(rows: DataFrame, drop: Column, after: datetime | None) -> Iterator[tuple[datetime, DataFrame]]:
    """The drops in ``rows`` that are newer than ``after``, oldest first: (time of the drop, its rows). Their times, not their rows, come to the driver."""
    newer = rows if after is None else rows.filter(drop > F.lit(after))
    for r in newer.select(drop.alias("at")).filter("at IS NOT NULL").distinct().orderBy("at").collect():
        yield r["at"], rows.filter(drop == F.lit(r["at"]))


def replay(rows: DataFrame, source: str, marks: Marks, step: Callable[[DataFrame, datetime], bool | None], drop: Column | None = None) -> list[datetime]:
    """Hand each drop beyond the source's mark to ``step``, oldest first, and move the mark after each that succeeded; returns the drops that moved it.

    A step that raises ends the run: the next one starts again at that drop. A step that returns False has had errors that do not end the run (a metric that could not be read): later drops are handed on, but the
    mark stays before the first drop with errors, so that it is taken up again. Steps must therefore bear being repeated, as keyed overwrites do.
    """
    moved, clean = [], True
    for at, own in drops(rows, F.col("ts") if drop is None else drop, marks.get(source)):
        clean = step(own, at) is not False and clean
        if clean:
            marks.move(source, at)
            moved.append(at)
    return moved
