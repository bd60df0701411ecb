"""Outage intervals, membership in them, and error metrics by interval, session and duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import haversine_m

DURATIONS = (5, 10, 30, 60)
FRACTIONS = (0.2, 0.4, 0.6, 0.8)


def session_lengths(steps: DataFrame) -> DataFrame:
    return steps.groupBy("session_id").agg(F.max("t_s").alias("total_s"))


def outage_intervals(lengths: DataFrame, durations: tuple[int, ...] = DURATIONS, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Reproducible outages: at whole seconds of fixed fractions of the session, kept if they end 2 s before it does.

    A session at most 10 s longer than the outage has one, centred, from 1 s on at the earliest.
    """
    rows = lengths.withColumn("duration_s", F.explode(F.array(*[F.lit(d) for d in durations])))
    short = F.col("total_s") <= F.col("duration_s") + 10.0
    middle = F.greatest(F.lit(1.0), ((F.col("total_s") - F.col("duration_s")) / 2.0).cast("long").cast("double"))
    spread = F.array(*[(F.lit(f) * F.col("total_s")).cast("long").cast("double") for f in fractions])
    spread = F.filter(spread, lambda s: s + F.col("duration_s") < F.col("total_s") - 2.0)
    rows = rows.select("session_id", "duration_s", F.posexplode(F.when(short, F.array(middle)).otherwise(spread)).alias("interval_idx", "start_s"))
    return rows.withColumn("end_s", F.col("start_s") + F.col("duration_s"))


def checked_intervals(intervals: DataFrame) -> DataFrame:
    """Fails on an interval that ends before it starts."""
    bad = F.concat(F.lit("interval ends before it starts: "), F.col("start_s").cast("string"))
    return intervals.where(F.when(F.col("end_s") < F.col("start_s"), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True)))


def in_outage(steps: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each step once for every duration of its session, with `is_blackout` (both ends of an interval belong to it) and
    the first interval that holds it (null: none).

    The session's few intervals travel as one array, so the steps are neither multiplied nor joined by range.
    """
    packed = F.struct("interval_idx", "start_s", "end_s")
    lists = intervals.groupBy("session_id", "duration_s").agg(F.array_sort(F.collect_list(packed)).alias("_iv"))
    met = steps.join(lists, "session_id")
    holding = F.filter("_iv", lambda x: F.col("t_s").between(x["start_s"], x["end_s"]))
    met = met.withColumn("_in", holding).withColumn("is_blackout", (F.size("_in") > 0) & (F.col("i") > 0))
    first = F.when(F.size("_in") > 0, F.col("_in")[0]["interval_idx"])
    return met.withColumn("interval_idx", first).drop("_iv", "_in")


def members(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points of each interval, closed at both ends; one that lies in two is in both."""
    keys = [c for c in ("session_id", "duration_s") if c in points.columns]
    rows = points.drop("interval_idx") if "interval_idx" in points.columns else points
    return rows.join(intervals, keys).where(F.col("t_s").between(F.col("start_s"), F.col("end_s")))


def interval_metrics(inside: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Final, largest and root-mean-square error, distance by estimated speed (left ends), drift and points of every
    interval, and of each value of the columns `also`. Distances up to a millimetre have no drift."""
    keys = [*also, "session_id", "duration_s", "interval_idx", "start_s", "end_s"]
    w = Window.partitionBy(*keys).orderBy("i")
    rows = inside.withColumn("_d", F.col("speed_ms") * (F.lead("t_s").over(w) - F.col("t_s")))
    found = rows.groupBy(*keys).agg(
        F.max_by("error_m", "i").alias("final_error_m"), F.max("error_m").alias("max_error_m"),
        F.sqrt(F.avg(F.col("error_m") * F.col("error_m"))).alias("rmse_error_m"),
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("traveled_distance_m"), F.count(F.lit(1)).alias("points_count"),
    )
    drift = F.when(F.col("traveled_distance_m") > 1e-3, F.col("final_error_m") / F.col("traveled_distance_m") * 100.0).otherwise(0.0)
    return found.withColumn("relative_drift_percent", drift)


MEANS = ("final_error_m", "max_error_m", "rmse_error_m", "traveled_distance_m", "relative_drift_percent")


def summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted means over intervals, their number and the total distance."""
    return metrics.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in MEANS], F.sum("traveled_distance_m").alias("total_traveled_distance_m"), F.count(F.lit(1)).alias("intervals")
    )


def summary_levels(metrics: DataFrame) -> DataFrame:
    """By session and duration, and by duration over all sessions, in one pass (session_id null)."""
    cube = metrics.groupingSets([["session_id", "duration_s"], ["duration_s"]], "session_id", "duration_s")
    return cube.agg(*[F.avg(c).alias(c) for c in MEANS], F.count(F.lit(1)).alias("intervals"))


def extended_metrics(inside: DataFrame) -> DataFrame:
    """Mean, median, 90th and 95th percentile (linear interpolation) and the error's growth per second (null for up to
    two points) of each interval."""
    found = inside.groupBy("session_id", "duration_s", "interval_idx").agg(
        F.avg("error_m").alias("mean_error_m"), F.median("error_m").alias("median_error_m"),
        F.percentile("error_m", 0.9).alias("p90_error_m"), F.percentile("error_m", 0.95).alias("p95_error_m"),
        F.count(F.lit(1)).alias("points_count"), F.regr_slope("error_m", F.col("t_s") - F.col("start_s")).alias("_slope"),
    )
    return found.withColumn("error_growth_rate_ms", F.when(F.col("points_count") > 2, F.col("_slope"))).drop("_slope")


def position_errors(points: DataFrame) -> DataFrame:
    return points.withColumn("error_m", haversine_m(F.col("lat"), F.col("lon"), F.col("gt_lat"), F.col("gt_lon")))
