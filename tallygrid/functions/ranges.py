"""Order over groups of any size: running sums and pages by ranges that lie side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.functions.folders import shared_folder


def _running(rows: DataFrame, group: list[str], order: list[Column], value: str, name: str, how: str, upto: int) -> DataFrame:
    shared_folder(rows.sparkSession)
    fold, zero = (F.sum, F.lit(0)) if how == "sum" else (F.max, F.lit(None))
    dealt = rows.repartitionByRange(*map(F.col, group), *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "__range").agg(F.coalesce(fold(value), zero).alias("__n"))
    bases = sums.withColumn("__base", F.coalesce(fold("__n").over(before), zero)).drop("__n")
    for c in group:
        bases = bases.withColumnRenamed(c, f"__{c}")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group] + [dealt["__range"] == bases["__range"]]
    inside = fold(value).over(Window.partitionBy(*group, dealt["__range"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto))
    both = dealt.join(bases, same)
    out = F.col("__base") + F.coalesce(inside, zero) if how == "sum" else F.greatest("__base", inside)
    return both.withColumn(name, out).select(*rows.columns, name)


def running_sum(rows: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of the group up to and with this one.

    Rows are range-partitioned by group and order, so a group of any size lies in as many tasks as it needs; each range sums on its own, and what lies before it is a sum over ranges, of which there are as many as
    partitions. ``order`` should leave no ties; null values add nothing. The ranges are checkpointed, since a second look at them must find the same.
    """
    return _running(rows, group, order, value, name, "sum", 0)


def running_max(rows: DataFrame, group: list[str], order: list[Column], value: str, name: str, before: bool = False) -> DataFrame:
    """As :func:`running_sum`, the greatest ``value`` up to and with the row, or (``before``) of the rows before it; null where there is none."""
    return _running(rows, group, order, value, name, "max", -1 if before else 0)


def with_total(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the row's group, by an aggregate that is joined back."""
    totals = rows.groupBy(*group).agg(F.sum(value).alias(name))
    for c in group:
        totals = totals.withColumnRenamed(c, f"__{c}")
    return rows.join(totals, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]).select(*rows.columns, name)


#: Pages that end within so many rows are a top-k; later ones look into the ranges of the order that hold them.
SHALLOW = 10_000


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int, at: str) -> DataFrame:
    """The ``limit`` rows behind ``offset`` by ``order`` (without ties), with their place as ``at`` (from 1); checkpointed, so that it is found once.

    A page near the top is a top-k. For a deep one the rows, which should be narrow, are range-partitioned by the order and counted, and only the ranges that hold the page are sorted.
    """
    shared_folder(rows.sparkSession)
    place = F.row_number().over(Window.orderBy(*order))
    if offset + limit <= SHALLOW:  # a top-k, then its tail: Spark's offset after a sort doesn't keep the order everywhere
        return rows.orderBy(*order).limit(offset + limit).withColumn(at, place).filter(F.col(at) > offset).checkpoint()
    dealt = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = dict(dealt.groupBy("__range").count().collect())  # a row per range
    held, before, base = [], 0, 0
    for k in sorted(counts):
        if before + counts[k] > offset and before < offset + limit:
            base = base if held else before
            held.append(k)
        before += counts[k]
    inside = dealt.filter(F.col("__range").isin(held)).drop("__range").orderBy(*order).limit(offset + limit - base)
    return inside.withColumn(at, place + base).filter(F.col(at) > offset).checkpoint()
