"""Who wastes GPU time, per user, cluster and cycle of weeks.

Input: usage rows of finished GPU jobs that have an occupancy (:func:`usage_rows`): user_id, cluster_id, end_s, cost and waste in weighted GPU seconds.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.functions.ranges import running_sum, with_total
from tallygrid.functions.timeaxis import DAY, epoch, seconds
from tallygrid.operators.jobseries import real, with_statistic, with_weights


def usage_rows(jobs: DataFrame, stats: DataFrame, weights: DataFrame, start: datetime | None = None, end: datetime | None = None, cluster_ids: Iterable[int] | None = None, where: Column | None = None) -> DataFrame:
    """Jobs that ended in [start, end) with a GPU type, a weight and a real occupancy, and meet ``where`` if given; adds end_s, cost and waste."""
    e = seconds(F.col("end_time"))
    out = jobs.filter(F.col("end_time").isNotNull() & F.col("allocated_gpu_type").isNotNull())
    if start is not None:
        out = out.filter(e >= epoch(start))
    if end is not None:
        out = out.filter(e < epoch(end))
    if cluster_ids:
        out = out.filter(F.col("cluster_id").isin(list(cluster_ids)))
    if where is not None:
        out = out.filter(where)
    out = with_statistic(with_weights(out, F.broadcast(weights)), stats, "gpu_sm_occupancy")
    cost = F.col("elapsed_time") * F.col("allocated_gres_gpu") * F.col("drac_rgu")
    out = out.withColumn("end_s", e).withColumn("cost", cost).withColumn("waste", (1 - F.col("gpu_sm_occupancy_mean")) * cost)
    return out.filter(real(F.col("waste")))


def email_selector(emails: list[str] | None, column: str = "email") -> Column:
    """None: all; addresses: only those; ``~address``: not those; only exclusions: all but those; []: nobody."""
    if emails is None:
        return F.lit(True)
    wanted, unwanted = [e for e in emails if not e.startswith("~")], [e[1:] for e in emails if e.startswith("~")]
    c = F.lit(True) if unwanted and not wanted else F.coalesce(F.col(column).isin(wanted), F.lit(False)) if wanted else F.lit(False)
    return c & ~F.coalesce(F.col(column).isin(unwanted), F.lit(False)) if unwanted else c


def _sums(ceiling: float) -> list[Column]:
    cost, waste = F.col("cost"), F.col("waste")
    return [
        F.sum(cost / 3600).alias("rgu_hours"), F.sum(cost / 3600 - waste / 3600).alias("true_used"),
        F.sum(cost / 3600 - F.greatest(F.lit(0.0), waste - cost * (1 - ceiling)) / 3600).alias("used"),
    ]


def user_usage(rows: DataFrame, ceiling: float = 1.0, keys: tuple[str, ...] = ("user_id",), keep: Column | None = None) -> DataFrame:
    """Hours, truly used and credited hours per user and cluster, with the user's totals over clusters beside (user_...); waste is hours minus credited hours. ``keep`` is a condition on them that users must meet."""
    by_cluster = rows.groupBy(*keys, "cluster_id").agg(*_sums(ceiling)).withColumn("wasted", F.col("rgu_hours") - F.col("used"))
    own = Window.partitionBy(*keys)
    total = {c: F.sum(c).over(own) for c in ("rgu_hours", "used", "wasted")}
    out = by_cluster.select("*", *[x.alias(f"user_{c}") for c, x in total.items()])
    out = out.withColumn("user_ratio", F.when(F.col("user_rgu_hours") > 0, F.col("user_wasted") / F.col("user_rgu_hours")).otherwise(F.lit(0.0)))
    return out if keep is None else out.filter(keep)


def active_users(rows: DataFrame, floor: float) -> DataFrame:
    """Users with at least ``floor`` hours."""
    return user_usage(rows).filter(F.col("user_rgu_hours") >= floor)


def underusers(rows: DataFrame, min_ratio: float, min_hours: float, ceiling: float = 1.0) -> DataFrame:
    """Users whose wasted share and wasted hours both reach the floors."""
    return user_usage(rows, ceiling).filter((F.col("user_ratio") >= min_ratio) & (F.col("user_wasted") >= min_hours))


def occupancy_of_job() -> Column:
    """min(1, 1 - waste / cost); a job without cost is fully used."""
    return F.when(F.col("cost") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 1 - F.col("waste") / F.col("cost")))


def classify_cycles(rows: DataFrame, anchor: date, weeks: int, cycles: int, trailing: int, min_ratio: float, min_hours: float, action_hours: float, ceiling: float = 1.0) -> DataFrame:
    """Every (cycle, user, cluster) of the ``cycles`` cycles that end at ``anchor`` and before: hours, waste, occupancy, isunderuser, flagged.

    Cycle 0 is the newest. A user is an underuser in a cycle by ratio and hours over all clusters, and flagged if the waste over the ``trailing``
    cycles up to it reaches ``action_hours`` too. All cycles come from one scan of ``cycles + trailing - 1`` of them and one aggregation.
    """
    step, top = weeks * 7 * DAY, epoch(anchor)
    position = F.floor((F.lit(top) - F.col("end_s") - 1e-6) / step).cast("int")  # [start, end) counted backwards
    seen = rows.withColumn("cycle", position).filter((F.col("cycle") >= 0) & (F.col("cycle") < cycles + trailing - 1))
    use = user_usage(seen, ceiling, ("cycle", "user_id"))
    per_user = use.groupBy("cycle", "user_id").agg(F.first("user_wasted").alias("w"))
    spread = per_user.withColumn("cycle", F.explode(F.sequence(F.greatest(F.col("cycle") - trailing + 1, F.lit(0)), F.col("cycle"))))
    window = spread.groupBy("cycle", "user_id").agg(F.sum("w").alias("trailing_wasted"))
    under = (F.col("user_ratio") >= min_ratio) & (F.col("user_wasted") >= min_hours)
    out = use.filter(F.col("cycle") < cycles).join(window, ["cycle", "user_id"])
    occupancy = F.when(F.col("rgu_hours") > 0, F.col("true_used") / F.col("rgu_hours")).otherwise(F.lit(1.0))
    return out.select("cycle", "user_id", "cluster_id", "rgu_hours", "wasted", occupancy.alias("sm_occ_mean"), under.alias("isunderuser"), (under & (F.col("trailing_wasted") >= action_hours)).alias("flagged"))


def escalated(cycle_flags: DataFrame, cycles: int, run: int) -> DataFrame:
    """(user_id, cycle, flagged) on a dense grid with elevated: this and the ``run - 1`` older cycles are all flagged."""
    users = cycle_flags.select("user_id").distinct()
    grid = users.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    flags = cycle_flags.groupBy("user_id", "cycle").agg(F.max("flagged").alias("flagged"), F.max("isunderuser").alias("isunderuser"))
    dense = grid.join(flags, ["user_id", "cycle"], "left").fillna(False, ["flagged", "isunderuser"])
    ahead = Window.partitionBy("user_id").orderBy("cycle").rowsBetween(0, run - 1)
    return dense.withColumn("elevated", F.sum(F.col("flagged").cast("int")).over(ahead) == run)


def marker(under: Column, flagged: Column, elevated: Column) -> Column:
    """The marker of a user in a cycle: empty for a cycle without data yet (null), then not an underuser, underuser, flagged, elevated."""
    return F.when(under.isNull(), "").when(~under, "✓").when(elevated, "!!⚑▲").when(flagged, "⚑▲").otherwise("▲")


def cycle_markers(flags: DataFrame, future: int = 0) -> DataFrame:
    """A :func:`marker` per (user, cycle); the ``future`` newest cycles have no data yet."""
    under = F.when(F.col("cycle") >= future, F.col("isunderuser"))
    return flags.withColumn("marker", marker(under, F.col("flagged"), F.col("elevated")))


def period_rows(classified: DataFrame, anchor: date, weeks: int, cycles: int, run: int) -> DataFrame:
    """The stored form of classified cycles: a row per (user, cluster, end_date)."""
    flags = escalated(classified, cycles, run).select("user_id", "cycle", "elevated")
    end = F.date_sub(F.lit(anchor), F.col("cycle") * (7 * weeks))
    return classified.join(flags, ["user_id", "cycle"]).select(
        "user_id", "cluster_id", F.date_sub(end, 7 * weeks).alias("start_date"), end.alias("end_date"), "sm_occ_mean", "rgu_hours", F.col("wasted").alias("unused_rguh"), "isunderuser", "flagged", "elevated")


def refresh_periods(stored: DataFrame, fresh: DataFrame, known_clusters: Iterable[int], oldest: date) -> DataFrame:
    """Stored periods with fresh ones in their place; unknown clusters are left out, cycles that ended before ``oldest`` pruned."""
    keys = ["user_id", "cluster_id", "end_date"]
    fresh = fresh.filter(F.col("cluster_id").isin(list(known_clusters)))
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh).filter(F.col("end_date") >= F.lit(oldest))


_PER_CYCLE = (("c", "isunderuser"), ("f", "flagged"), ("e", "elevated"))


def _wide_flags(flags: DataFrame, cycles: int) -> DataFrame:
    """(user_id, c0 .., f0 .., e0 ..): whether the user is an underuser, is flagged and escalates in each cycle."""
    return flags.groupBy("user_id").agg(*[F.coalesce(F.max(F.when(F.col("cycle") == i, F.col(c))), F.lit(False)).alias(f"{n}{i}") for n, c in _PER_CYCLE for i in range(cycles)])


def recurring_underusers(classified: DataFrame, active: int, cycles: int, run: int, future: int = 0) -> DataFrame:
    """Per cluster the users with waste in the ``active`` newest cycles: waste and share of the cluster, and for each displayed cycle (0 the newest) c: an underuser, f: flagged, e: escalates.

    The ``future`` newest cycles have no data yet: their flags are null.
    """
    window = classified.filter(F.col("cycle") < active).groupBy("cluster_id", "user_id").agg(F.sum("wasted").alias("wasted"), F.sum(F.col("rgu_hours") * (1 - F.col("sm_occ_mean"))).alias("true_wasted")).filter("wasted > 0")
    wide = _wide_flags(escalated(classified, cycles, run), cycles)
    known = [(F.col(f"{n}{i}") if i >= future else F.lit(None).cast("boolean")).alias(f"{n}{i}") for n, _ in _PER_CYCLE for i in range(cycles)]
    out = with_total(window.join(wide, "user_id"), ["cluster_id"], "wasted", "all_wasted")
    return out.select("cluster_id", "user_id", "wasted", "true_wasted", *known, (F.col("wasted") / F.col("all_wasted")).alias("cluster_share"))


def recurring_from_periods(periods: DataFrame, anchor: date, weeks: int, cycles: int, active: int) -> DataFrame:
    """:func:`recurring_underusers` from stored periods (:func:`period_rows`), over the ``cycles`` that end at ``anchor`` and before; flags of cycles newer than any stored one are null."""
    cycle = (F.datediff(F.lit(anchor), "end_date") / (7 * weeks)).cast("int")
    x = periods.withColumn("cycle", cycle).filter((F.col("cycle") >= 0) & (F.col("cycle") < cycles))
    newest = x.agg(F.min("cycle").alias("ahead"))  # one row
    window = x.filter(F.col("cycle") < active).groupBy("cluster_id", "user_id").agg(F.sum("unused_rguh").alias("wasted")).filter("wasted > 0")
    wide = _wide_flags(x.groupBy("user_id", "cycle").agg(*[F.max(c).alias(c) for _, c in _PER_CYCLE]), cycles)
    out = with_total(window.join(wide, "user_id"), ["cluster_id"], "wasted", "all_wasted").crossJoin(F.broadcast(newest))  # the right side is one row
    known = [F.when(F.col("ahead") <= i, F.col(f"{n}{i}")).alias(f"{n}{i}") for n, _ in _PER_CYCLE for i in range(cycles)]
    share = (F.col("wasted") / F.col("all_wasted")).alias("cluster_share")
    return out.select("cluster_id", "user_id", "wasted", share, *known).orderBy("cluster_id", F.col("wasted").desc(), "user_id")


#: Hours in a week of one weighted GPU, and of the model that readers know (weight 4.8).
RGU_WEEK, MODEL_WEEK = 24 * 7, 4.8 * 24 * 7


def in_units(hours: Column, hours_per_unit: float = RGU_WEEK) -> Column:
    """Weighted hours in a display unit, with one decimal."""
    return F.format_string("%.1f", hours / F.lit(float(hours_per_unit)))


def in_whole_units(hours: Column, hours_per_unit: float = RGU_WEEK) -> Column:
    """Weighted hours in whole display units (halves to even), thousands apart by blanks."""
    return F.replace(F.format_number(F.bround(hours / F.lit(float(hours_per_unit)), 0), 0), F.lit(","), F.lit(" "))


def percent(fraction: Column) -> Column:
    return F.format_string("%.1f %%", fraction * 100)


def cumulative_share_cut(rows: DataFrame, threshold: float, value: str = "wasted") -> DataFrame:
    """Users of each cluster from the top until their cumulative share reaches ``threshold``; the one who crosses it stays. Sums run over ranges of a cluster's users, so no task holds a whole cluster."""
    running = running_sum(rows, ["cluster_id"], [F.col(value).desc(), F.col("user_id")], value, "__upto")
    both = with_total(running, ["cluster_id"], value, "__total")
    before = F.col("__upto") - F.col(value)
    return both.filter((before < threshold * F.col("__total")) | (before == 0)).select(*rows.columns)


def top_and_bottom_jobs(rows: DataFrame, n: int) -> DataFrame:
    """Per user the ``n`` jobs with most waste, then of the rest the ``n`` with the best occupancy; no job twice."""
    worst = Window.partitionBy("user_id").orderBy(F.col("waste").desc(), "job_db_id")
    ranked = rows.withColumn("occupancy", occupancy_of_job()).withColumn("worst", F.row_number().over(worst))
    best = Window.partitionBy("user_id").orderBy(F.col("occupancy").desc(), "job_db_id")
    rest = ranked.filter(F.col("worst") > n).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).withColumn("list", F.lit("best"))
    return ranked.filter(F.col("worst") <= n).withColumn("rank", F.col("worst")).withColumn("list", F.lit("worst")).unionByName(rest).drop("worst")


def digest_top(usage: DataFrame, n: int) -> DataFrame:
    """The ``n`` users with most waste, with the cluster where they waste most."""
    per = usage.groupBy("user_id").agg(F.first("user_wasted").alias("wasted"), F.max_by("cluster_id", F.struct("wasted", "cluster_id")).alias("worst_cluster"))
    return per.orderBy(F.col("wasted").desc(), "user_id").limit(n)


def listing_by_cluster(jobs: DataFrame, value: str = "waste") -> DataFrame:
    """Listed jobs with the order of their cluster within the user's list: largest sum of ``value`` first."""
    sums = jobs.withColumn("cluster_sum", F.sum(value).over(Window.partitionBy("user_id", "cluster_id")))
    return sums.withColumn("cluster_rank", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.col("cluster_sum").desc(), "cluster_id")))


def recipients(active: DataFrame, flagged: DataFrame, on: str = "user_id") -> DataFrame:
    """Active users who are not flagged."""
    return active.select(on).distinct().join(flagged.select(on), on, "left_anti")


def report_due(day: Column, weeks: int, offset: int = 0) -> Column:
    """Whether a report is due in the ISO week of ``day``."""
    return F.pmod(F.weekofyear(day) - offset, F.lit(weeks)) == 0


def recurring_table(rows: DataFrame, cycles: int, active: int, base_url: str) -> DataFrame:
    """The export: cluster, user, link, waste, share, one :func:`marker` per cycle (empty where there is no data yet) and an empty column after the active ones."""
    mark = [marker(*(F.col(f"{n}{i}") for n in "cfe")).alias(f"cycle_{i}") for i in range(cycles)]
    link = F.concat(F.lit(f"{base_url}?user="), F.url_encode(F.col("user_id").cast("string")))
    known = ["cluster_id", "user_id", link.alias("link"), F.round("wasted", 2).alias("wasted"), F.round("cluster_share", 4).alias("share")]
    return rows.select(*known, *mark[:active], F.lit("").alias("separator"), *mark[active:]).orderBy("cluster_id", F.col("wasted").desc(), "user_id")


def export_recurring(table: DataFrame, path: str) -> None:
    """Write the export as CSV files with a header, in its order: file after file, however many there are."""
    table.write.option("header", True).option("encoding", "UTF-8").option("emptyValue", "").csv(path)
