"""The error-state filter over the event sessions, model inference, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import blackout as B
from wayline.operators import filter_batch as FB
from wayline.operators import roads as R
from wayline.operators.infer import infer
from wayline.operators.sequence import sliding_windows
from wayline.plans import oracles as O
from wayline.plans.common import event_intervals, r, rounded
from wayline.plans.onnx_models import linear_over_window
from wayline.sources.events import raw_steps, true_steps

KEYS = ["session_id", "duration_s", "interval_idx"]


def _steps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every step of every session, once for each outage schedule that it has, and the intervals."""
    intervals = event_intervals(spark, sf)
    return FB.event_steps(B.in_outage(true_steps(spark, sf), intervals)), intervals


def _errors(points: DataFrame, intervals: DataFrame) -> DataFrame:
    return B.summary(B.interval_metrics(B.members(B.position_errors(points), intervals)), ["session_id", "duration_s"])


def ekf_version_a(spark: SparkSession, sf: str) -> DataFrame:
    """Mean errors of each session, filtered with speeds, the track constraint, measured rotations and fixes outside
    outages."""
    steps, intervals = _steps(spark, sf)
    found = _errors(FB.run_filter(steps), intervals)
    return rounded(found, ["session_id", "duration_s", "intervals"], 3, **{c: c for c in B.MEANS})


def _road_inputs(spark: SparkSession, sf: str, lookback_s: float = 120.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps, the segments of each interval's road from the fixes before it, and the intervals."""
    steps, intervals = _steps(spark, sf)
    fixes = true_steps(spark, sf).select("session_id", "i", "t_s", "gt_lat", "gt_lon")
    first = fixes.where("i = 0").select("session_id", F.col("gt_lat").alias("ref_lat"), F.col("gt_lon").alias("ref_lon"))
    return steps, R.segments(R.past_roads(fixes.join(first, "session_id"), intervals, lookback_s), KEYS), intervals


def ekf_version_b_road(spark: SparkSession, sf: str, lookback_s: float = 120.0, use: FB.Settings = FB.Settings()) -> DataFrame:
    """As version A with roads of the fixes before each outage; look-back and the road's settings are parameters."""
    steps, roads, intervals = _road_inputs(spark, sf, lookback_s)
    points = FB.run_filter_on_roads(steps, roads, use)
    found = _errors(points, intervals)
    outcomes = points.where("road_outcome is not null").groupBy("session_id", "duration_s")
    counts = outcomes.agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("road_outcome") == "matched").alias("n_matched"), F.coalesce(F.avg("correction_m"), F.lit(0.0)).alias("avg_correction_m"))
    found = found.join(counts, ["session_id", "duration_s"], "left")
    return rounded(found, ["session_id", "duration_s", "intervals", "n_steps", "n_matched"], 3, **{c: c for c in B.MEANS}, avg_correction_m="avg_correction_m")


def ekf_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean final error by duration without one measurement after another."""
    steps, intervals = _steps(spark, sf)
    uses = {"all": FB.Settings(), "no_speed": FB.Settings(speed=False), "no_track": FB.Settings(track=False), "no_turn": FB.Settings(turn=False)}
    points = B.position_errors(FB.run_variants(steps, uses))
    metrics = B.interval_metrics(B.members(points, intervals), ("variant",))
    found = metrics.groupBy("duration_s", "variant").agg(F.avg("final_error_m").alias("final_error_m"), F.count(F.lit(1)).alias("intervals"))
    return found.select("duration_s", "variant", r("final_error_m", 3).alias("final_error_m"), "intervals")


def onnx_infer(spark: SparkSession, sf: str) -> DataFrame:
    """A linear model over each window against the same sum as an expression."""
    rows = raw_steps(spark, sf).withColumnRenamed("i", "seq").withColumn("gyro_x", F.lit(0.0)).withColumn("gyro_y", F.lit(0.0))
    windows = sliding_windows(rows, ["accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z"])
    weights = [0.5, -0.25, 0.125, 0.0, 0.0, 1.0]
    found = infer(windows, linear_over_window(weights, 50), "imu", "predicted")
    summed = F.aggregate("imu", F.lit(0.0), lambda a, x: a + sum(w * x[i] for i, w in enumerate(weights))) / 50
    return found.select("session_id", "window_idx", r(summed, 6).alias("expected"), (F.abs(F.col("predicted") - summed) < 1e-4).alias("agrees"))


QUERIES = {f.__name__: f for f in (ekf_version_a, ekf_version_b_road, ekf_ablation, onnx_infer)}
ORACLES: dict[str, str] = {
    "onnx_infer": O.sql(f"""SELECT session_id, CAST((i - 49) // 10 AS BIGINT) AS window_idx, {O.r("total / 50")} AS expected, true AS agrees FROM (
      SELECT session_id, i, sum(0.5 * accel_x - 0.25 * accel_y + 0.125 * accel_z + gyro_z) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS total FROM raw)
      WHERE i >= 49 AND (i - 49) % 10 = 0"""),
}
