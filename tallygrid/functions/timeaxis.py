"""Spans, windows and buckets of time. Spans are half-open: [start, start + elapsed)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOUR, DAY, WEEK = 3600, 86400, 604800
_MONDAY = 4 * DAY  # 1970-01-05 was a Monday


def seconds(moment: Column) -> Column:
    """A timestamp as seconds since 1970, with fractions."""
    return F.unix_micros(moment.cast("timestamp")) / 1e6


def epoch(moment: datetime | date) -> float:
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    return (moment if moment.tzinfo else moment.replace(tzinfo=UTC)).timestamp()


def run_end(start: str = "start_time", elapsed: str = "elapsed_time") -> Column:
    """When a run ended by its elapsed time; null for a job that never started or has no length."""
    return F.when(F.col(elapsed) > 0, F.timestamp_micros(F.unix_micros(F.col(start).cast("timestamp")) + (F.col(elapsed) * 1e6).cast("long")))


def ran_between(lo: datetime, hi: datetime, start: str = "start_time", elapsed: str = "elapsed_time") -> Column:
    """Whether the span of a job meets [lo, hi) in more than an edge."""
    s = seconds(F.col(start))
    return (F.col(elapsed) > 0) & (s + F.col(elapsed) > epoch(lo)) & (s < epoch(hi))


def overlap_hours(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Hours of [start, end) inside [lo, hi), all in seconds."""
    return (F.least(end, hi) - F.greatest(start, lo)) / HOUR


def effective_start() -> Column:
    """Data checks take the submission for the start of a job that never started."""
    return F.coalesce(F.col("start_time"), F.col("submit_time")).cast("timestamp")


def effective_end() -> Column:
    """Data checks take the recorded end, else start and elapsed time, else the submission."""
    by_elapsed = F.timestamp_micros(F.unix_micros(F.col("start_time").cast("timestamp")) + (F.col("elapsed_time") * 1e6).cast("long"))
    return F.coalesce(F.col("end_time").cast("timestamp"), by_elapsed, F.col("submit_time").cast("timestamp"))


@dataclass(frozen=True)
class Period:
    """A bucket length: fixed seconds, or calendar months."""

    seconds: int = 0
    months: int = 0
    calendar: bool = False


def parse_period(text: str) -> Period:
    """``h``, ``d``, ``w``, ``m``: calendar units; ``6h``, ``2d``, ``3w``, ``1m`` (30 days) or a bare number of days: fixed lengths."""
    m = re.fullmatch(r"(\d*)([hdwm]?)", text.strip().lower())
    if not m or not m[0]:
        raise ValueError(f"not a period: {text!r}")
    unit = {"h": HOUR, "d": DAY, "w": WEEK, "m": 30 * DAY, "": DAY}[m[2]]
    if not m[1]:
        return Period(months=1, calendar=True) if m[2] == "m" else Period(seconds=unit, calendar=True)
    if int(m[1]) == 0:
        raise ValueError("a period is longer than zero")
    return Period(seconds=int(m[1]) * unit)


def date_range(start: date | None, end: date | None, today: date, focus: tuple[date, date] | None = None) -> tuple[date, date]:
    """The window of a report: yesterday to today by default, put in order, cut to ``focus`` (it may be empty then)."""
    lo, hi = start or today - timedelta(days=1), end or today
    if lo > hi:
        lo, hi = hi, lo
    if focus:
        lo, hi = max(lo, min(focus)), min(hi, max(focus))
        hi = max(lo, hi)
    return lo, hi


@dataclass(frozen=True)
class Axis:
    """Buckets that tile [begin, finish); calendar buckets are aligned, the first and the last one clipped."""

    begin: datetime
    finish: datetime
    period: Period

    @property
    def origin(self) -> float:
        if not self.period.calendar:
            return epoch(self.begin)
        step, at = self.period.seconds, epoch(self.begin)
        shift = _MONDAY if step == WEEK else 0
        return (at - shift) // step * step + shift if step else 0.0

    def index(self, at: Column, edge: bool = False) -> Column:
        """The bucket of a moment in seconds; with ``edge`` the last bucket of a span that ends there."""
        if self.period.months:
            t = F.timestamp_micros(((at * 1e6).cast("long") - 1) if edge else (at * 1e6).cast("long"))
            return (F.year(t) * 12 + F.month(t) - 1).cast("int")
        x = (at - self.origin) / self.period.seconds
        return (F.ceil(x) - 1 if edge else F.floor(x)).cast("int")

    def low(self, index: Column) -> Column:
        return F.greatest(self._edge(index), F.lit(epoch(self.begin)))

    def high(self, index: Column) -> Column:
        return F.least(self._edge(index + 1), F.lit(epoch(self.finish)))

    def _edge(self, index: Column) -> Column:
        if self.period.months:
            return F.unix_timestamp(F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1)).cast("timestamp")).cast("double")
        return index * F.lit(float(self.period.seconds)) + self.origin

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per bucket: bucket, lo_s, hi_s."""
        if self.finish <= self.begin:
            return spark.createDataFrame([], "bucket int, lo_s double, hi_s double")
        lo, hi = F.lit(epoch(self.begin)), F.lit(epoch(self.finish))
        rows = spark.range(1).select(F.explode(F.sequence(self.index(lo), self.index(hi, edge=True))).alias("bucket"))
        return rows.select("bucket", self.low(F.col("bucket")).alias("lo_s"), self.high(F.col("bucket")).alias("hi_s"))


def span_to_buckets(jobs: DataFrame, axis: Axis, start: str = "start_time", elapsed: str = "elapsed_time") -> DataFrame:
    """Each job once per bucket that its span overlaps, with bucket, lo_s and overlap_h. Spans that only touch a bucket's edge are not in it.

    The buckets of a span follow by arithmetic on indexes, so there is no range join and no shuffle.
    """
    s = seconds(F.col(start))
    e, lo, hi = s + F.col(elapsed), F.lit(epoch(axis.begin)), F.lit(epoch(axis.finish))
    inside = jobs.filter(ran_between(axis.begin, axis.finish, start, elapsed)) if axis.finish > axis.begin else jobs.limit(0)
    each = inside.withColumn("bucket", F.explode(F.sequence(axis.index(F.greatest(s, lo)), axis.index(F.least(e, hi), edge=True))))
    b = F.col("bucket")
    return each.withColumn("lo_s", axis.low(b)).withColumn("overlap_h", overlap_hours(s, e, axis.low(b), axis.high(b)))


def frames_of(jobs: DataFrame, begin: datetime, finish: datetime, step_s: int) -> DataFrame:
    """Each job once per fixed frame with eff_start < frame end and eff_end >= frame start: closed on the left, so jobs of no length count."""
    s, e, lo = seconds(effective_start()), seconds(effective_end()), epoch(begin)
    n = int((epoch(finish) - lo) // step_s)
    if n <= 0:
        return jobs.limit(0).withColumn("frame", F.lit(0))
    first = F.greatest(F.floor((s - lo) / step_s), F.lit(0)).cast("int")
    last = F.least(F.floor((e - lo) / step_s), F.lit(n - 1)).cast("int")
    kept = jobs.filter((s < lo + n * step_s) & (e >= lo) & (first <= last))
    return kept.withColumn("frame", F.explode(F.sequence(first, last)))


def cycle_ends(end: date, weeks: int, count: int) -> list[date]:
    """Ends of the ``count`` newest cycles of ``weeks`` weeks, newest first: the newest is the first Monday on or after ``end`` whose ISO week is divisible by ``weeks``; week 53 is in no cycle."""
    anchor = end + timedelta(days=(-end.weekday()) % 7)
    while anchor.isocalendar()[1] % weeks or anchor.isocalendar()[1] == 53:
        anchor += timedelta(days=7)
    return [anchor - timedelta(weeks=weeks * k) for k in range(count)]


def due_intervals(mark: datetime, now: datetime, minutes: int) -> list[tuple[datetime, datetime]]:
    """Consecutive intervals from the last mark, the incomplete one left out; one interval up to now if ``minutes`` is not positive."""
    if minutes <= 0:
        return [(mark, now)] if mark < now else []
    step, out = timedelta(minutes=minutes), []
    while mark + step <= now:
        out.append((mark, mark + step))
        mark += step
    return out
