"""Dead reckoning through outages, and its error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.geo import wrap_degrees
from wayline.operators import blackout as B
from wayline.operators import stats
from wayline.operators.deadreckon import circular_blended, headings, with_dt
from wayline.operators.tracking import evaluate, track
from wayline.plans import oracles as O
from wayline.plans import reports
from wayline.plans.common import CHUNK_ROWS, event_intervals, metrics, r, rounded, tracked
from wayline.sources.events import raw_steps, session_lengths, true_steps
from wayline.sources.synthetic import straight_drive

KEYS = ["session_id", "duration_s", "interval_idx"]
MEANS = {c: c for c in B.MEANS}
MEAN_SQL = ", ".join(f"{O.r(f'avg({c})', 5)} AS {c}" for c in B.MEANS)


def dr_heading_integration(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_dt(raw_steps(spark, sf), ["session_id"]).withColumn("_init", F.lit(90.0))
    rows = headings(rows, "gyro_z", "_init", ["session_id"])
    return rounded(rows, ["session_id", "i"], east=F.sin("heading_rad"), north=F.cos("heading_rad"))


def dr_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    points, _ = tracked(spark, sf)
    return rounded(points, ["session_id", "duration_s", "i", "is_blackout"], 8, lat="lat", lon="lon")


def dr_trajectory_chunked(spark: SparkSession, sf: str) -> DataFrame:
    """As dr_trajectory, from numbering to positions without a task that sees a whole session."""
    intervals = B.outage_intervals(session_lengths(spark, sf))
    points = track(true_steps(spark, sf, CHUNK_ROWS, ["speed_ms", "gyro_z"]), intervals, chunk=CHUNK_ROWS)
    return rounded(points, ["session_id", "duration_s", "i", "is_blackout"], 8, lat="lat", lon="lon")


def dr_errors(spark: SparkSession, sf: str) -> DataFrame:
    points, _ = tracked(spark, sf)
    return rounded(points, ["session_id", "duration_s", "i"], 5, error_m="error_m")


def blackout_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return B.checked_intervals(event_intervals(spark, sf)).select(*KEYS, "start_s", "end_s")


def blackout_membership(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.in_outage(raw_steps(spark, sf), event_intervals(spark, sf))
    return rows.select("session_id", "duration_s", "i", "is_blackout", "interval_idx")


def blackout_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics(spark, sf), [*KEYS, "start_s", "end_s", "points_count"], 5, **MEANS)


def blackout_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = B.summary(metrics(spark, sf), ["duration_s"])
    return rounded(found, ["duration_s", "intervals"], 5, **MEANS, total_traveled_distance_m="total_traveled_distance_m")


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = B.summary(metrics(spark, sf), ["session_id", "duration_s"])
    return rounded(found, ["session_id", "duration_s", "intervals"], 5, **MEANS, total_traveled_distance_m="total_traveled_distance_m")


def blackout_summary_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.summary_levels(metrics(spark, sf)), ["session_id", "duration_s", "intervals"], 5, **MEANS)


def extended_metrics(spark: SparkSession, sf: str) -> DataFrame:
    points, intervals = tracked(spark, sf)
    found = B.extended_metrics(B.members(points, intervals))
    names = ("mean_error_m", "median_error_m", "p90_error_m", "p95_error_m")
    return rounded(found, [*KEYS, "points_count"], 5, **{n: n for n in names})


def error_growth_slope(spark: SparkSession, sf: str) -> DataFrame:
    points, intervals = tracked(spark, sf)
    return rounded(B.extended_metrics(B.members(points, intervals)), KEYS, 5, error_growth_rate_ms="error_growth_rate_ms")


def dr_heading_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Headings turned by 90 degrees, so that rounding can't put a due-north one on either side of the seam."""
    steps = true_steps(spark, sf).withColumn("gt_heading_deg", wrap_degrees(F.col("gt_heading_deg") + 90))
    points = track(steps, event_intervals(spark, sf), blend=True)
    return rounded(points, ["session_id", "duration_s", "i"], 5, east=F.sin("heading_rad"), north=F.cos("heading_rad"))


def blend_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean errors by duration with satellite headings blended along the shorter arc."""
    found = B.summary(metrics(spark, sf, blend=True, rule=circular_blended), ["duration_s"])
    return rounded(found, ["duration_s", "intervals"], 5, **MEANS)


def elapsed_time(spark: SparkSession, sf: str) -> DataFrame:
    points = raw_steps(spark, sf).select("session_id", "i", "t_s")
    inside = B.members(points, event_intervals(spark, sf))
    return inside.select(*KEYS, "i", (F.col("t_s") - F.col("start_s")).alias("elapsed_s"))


def _versions(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Three trackers' summaries to compare: estimated speed, true speed, and a standstill."""
    intervals, steps = event_intervals(spark, sf), true_steps(spark, sf)
    found = {}
    for name, speed in (("baseline", F.col("speed_ms")), ("version_a", F.col("true_speed")), ("version_b", F.col("speed_ms") * 0.0)):
        found[name] = B.summary(evaluate(steps.withColumn("speed_ms", speed), intervals), ["duration_s"])
    return found


def comparison_unpivot_join(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.compared(_versions(spark, sf), ["duration_s"], ["final_error_m", "max_error_m", "rmse_error_m"])
    return rounded(found, ["duration_s", "metric"], 4, baseline="baseline", version_a="version_a", version_b="version_b")


def improvement(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.compared({k: v for k, v in _versions(spark, sf).items() if k != "version_b"}, ["duration_s"], ["final_error_m"])
    found = stats.improvement(found, "baseline", "version_a")
    return found.select("duration_s", r("absolute_improvement", 3).alias("absolute_improvement"), r("percent_improvement", 2).alias("percent_improvement"))


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """The summary by duration as one nested document."""
    found = reports.json_report(B.summary(metrics(spark, sf), ["duration_s"]), ["duration_s"], ["intervals"], 0)
    return found.select(F.get_json_object("report", "$.5.intervals").cast("double").alias("five"), F.get_json_object("report", "$.30.intervals").cast("double").alias("thirty"))


def error_lines(spark: SparkSession, sf: str) -> DataFrame:
    points, intervals = tracked(spark, sf)
    found = reports.error_lines(B.members(points, intervals))
    return rounded(found, ["duration_s", "elapsed_s", "n"], 4, error_m="error_m")


def synthetic_drive(spark: SparkSession, sf: str) -> DataFrame:
    found = straight_drive(spark, heading_deg=45.0)
    return rounded(found, ["i"], 8, t_s="t_s", gt_lat="gt_lat", gt_lon="gt_lon")


QUERIES = {f.__name__: f for f in (
    dr_heading_integration, dr_trajectory, dr_trajectory_chunked, dr_errors, blackout_intervals, blackout_membership, blackout_metrics, blackout_summary, session_summary,
    blackout_summary_grouping_sets, extended_metrics, error_growth_slope, dr_heading_blend, blend_summary, elapsed_time, comparison_unpivot_join, improvement,
    json_report, error_lines, synthetic_drive,
)}


def _track(name: str, speed: str) -> str:
    """CTEs of a tracker with another speed, ending in <name>(duration_s, metric means)."""
    body = O.PRELUDE[O.PRELUDE.index("runs AS") : O.PRELUDE.index("windows AS")].rstrip().rstrip(",")
    for cte in ("runs", "est_lat", "est_lag", "est", "errors", "inside_d", "inside", "metrics0", "metrics"):
        body = body.replace(f"{cte} AS (", f"{name}_{cte} AS (").replace(f"FROM {cte} ", f"FROM {name}_{cte} ").replace(f"FROM {cte})", f"FROM {name}_{cte})").replace(f"FROM {cte}\n", f"FROM {name}_{cte}\n")
    return body.replace("speed_ms", f"({speed})")


_VERSION_SQL = O.PRELUDE + ", " + _track("a", "true_speed") + ", " + _track("b", "speed_ms * 0.0") + """, versions AS (
  SELECT 'baseline' AS v, duration_s, final_error_m, max_error_m, rmse_error_m FROM metrics UNION ALL
  SELECT 'version_a', duration_s, final_error_m, max_error_m, rmse_error_m FROM a_metrics UNION ALL
  SELECT 'version_b', duration_s, final_error_m, max_error_m, rmse_error_m FROM b_metrics),
means AS (SELECT v, duration_s, avg(final_error_m) AS final_error_m, avg(max_error_m) AS max_error_m, avg(rmse_error_m) AS rmse_error_m FROM versions GROUP BY ALL),
long AS (SELECT v, duration_s, metric, value FROM means UNPIVOT (value FOR metric IN (final_error_m, max_error_m, rmse_error_m)))
"""  # fmt: skip
_PIVOT = ", ".join(f"max(value) FILTER (WHERE v = '{v}') AS {v}" for v in ("baseline", "version_a", "version_b"))

def _blended() -> str:
    """The tracker's CTEs with headings that a tenth of the satellite's is blended into along the shorter arc."""
    start, end = O.PRELUDE.index("est_h AS ("), O.PRELUDE.index("runs AS (")
    moved, turn = "(b.h + v.gyro_z * v.dt)", "(radians(v.gt_heading_deg) - (b.h + v.gyro_z * v.dt))"
    blend = f"""blend AS (
      SELECT session_id, duration_s, i, {O.wrap("radians(gt_heading_deg)")} AS h FROM variants WHERE i = 0 UNION ALL
      SELECT v.session_id, v.duration_s, v.i, {O.wrap(f"{moved} + CASE WHEN v.is_blackout THEN 0.0 ELSE 0.1 * ({turn} - 2 * pi() * round({turn} / (2 * pi()))) END")}
      FROM blend b JOIN variants v ON v.session_id = b.session_id AND v.duration_s = b.duration_s AND v.i = b.i + 1),
    est_h AS (SELECT v.*, b.h, (v.i = 0 OR NOT v.is_blackout) AS fix FROM variants v JOIN blend b ON b.session_id = v.session_id AND b.duration_s = v.duration_s AND b.i = v.i),
    """
    return (O.PRELUDE[:start] + blend + O.PRELUDE[end:]).replace("WITH ev", "WITH RECURSIVE ev")


ORACLES = {
    "blend_summary": _blended() + f"SELECT duration_s, count(*) AS intervals, {MEAN_SQL} FROM metrics GROUP BY 1",
    "dr_heading_integration": O.sql(f"""SELECT session_id, i, {O.r("sin(h)")} AS east, {O.r("cos(h)")} AS north FROM (
      SELECT session_id, i, pi() / 2 + sum(gyro_z * dt) OVER (PARTITION BY session_id ORDER BY i) AS h FROM raw)"""),
    "dr_trajectory": O.sql(f"SELECT session_id, duration_s, i, is_blackout, {O.r('lat', 8)} AS lat, {O.r('lon', 8)} AS lon FROM est"),
    "dr_errors": O.sql(f"SELECT session_id, duration_s, i, {O.r('error_m', 5)} AS error_m FROM errors"),
    "blackout_intervals": O.sql("SELECT * FROM intervals"),
    "blackout_membership": O.sql("""SELECT s.session_id, d.duration_s, s.i, s.i > 0 AND min(v.interval_idx) IS NOT NULL AS is_blackout,
      min(v.interval_idx) AS interval_idx FROM raw s JOIN (SELECT DISTINCT session_id, duration_s FROM intervals) d USING (session_id)
      LEFT JOIN intervals v ON v.session_id = s.session_id AND v.duration_s = d.duration_s AND s.t_s BETWEEN v.start_s AND v.end_s
      GROUP BY s.session_id, d.duration_s, s.i"""),
    "blackout_metrics": O.sql(f"SELECT session_id, duration_s, interval_idx, start_s, end_s, points_count, {', '.join(f'{O.r(c, 5)} AS {c}' for c in B.MEANS)} FROM metrics"),
    "blackout_summary": O.sql(f"SELECT duration_s, count(*) AS intervals, {MEAN_SQL}, {O.r('sum(traveled_distance_m)', 5)} AS total_traveled_distance_m FROM metrics GROUP BY 1"),
    "session_summary": O.sql(f"SELECT session_id, duration_s, count(*) AS intervals, {MEAN_SQL}, {O.r('sum(traveled_distance_m)', 5)} AS total_traveled_distance_m FROM metrics GROUP BY 1, 2"),
    "blackout_summary_grouping_sets": O.sql(f"SELECT session_id, duration_s, count(*) AS intervals, {MEAN_SQL} FROM metrics GROUP BY GROUPING SETS ((session_id, duration_s), (duration_s))"),
    "extended_metrics": O.sql(f"""SELECT session_id, duration_s, interval_idx, count(*) AS points_count, {O.r("avg(error_m)", 5)} AS mean_error_m,
      {O.r("quantile_cont(error_m, 0.5)", 5)} AS median_error_m, {O.r("quantile_cont(error_m, 0.9)", 5)} AS p90_error_m,
      {O.r("quantile_cont(error_m, 0.95)", 5)} AS p95_error_m FROM inside GROUP BY 1, 2, 3"""),
    "error_growth_slope": O.sql(f"""SELECT session_id, duration_s, interval_idx, CASE WHEN count(*) > 2 THEN {O.r("regr_slope(error_m, t_s - start_s)", 5)} END
      AS error_growth_rate_ms FROM inside GROUP BY 1, 2, 3"""),
    "dr_heading_blend": O.PRELUDE.replace("WITH ev", "WITH RECURSIVE ev") + f""", blend AS (
      SELECT session_id, duration_s, i, pi() / 2 + th AS h FROM variants WHERE i = 0 UNION ALL
      SELECT v.session_id, v.duration_s, v.i, {O.wrap("CASE WHEN v.is_blackout THEN b.h + v.gyro_z * v.dt ELSE 0.9 * (b.h + v.gyro_z * v.dt) + 0.1 * " + O.wrap("v.th + pi() / 2") + " END")}
      FROM blend b JOIN variants v ON v.session_id = b.session_id AND v.duration_s = b.duration_s AND v.i = b.i + 1)
      SELECT session_id, duration_s, i, {O.r("sin(h)", 5)} AS east, {O.r("cos(h)", 5)} AS north FROM blend""",
    "elapsed_time": O.sql("""SELECT v.session_id, v.duration_s, v.interval_idx, s.i, s.t_s - v.start_s AS elapsed_s FROM raw s JOIN intervals v
      ON v.session_id = s.session_id AND s.t_s BETWEEN v.start_s AND v.end_s"""),
    "comparison_unpivot_join": _VERSION_SQL + f"SELECT duration_s, metric, {', '.join(f'{O.r(v, 4)} AS {v}' for v in ('baseline', 'version_a', 'version_b'))} FROM (SELECT duration_s, metric, {_PIVOT} FROM long GROUP BY 1, 2)",
    "improvement": _VERSION_SQL + f"""SELECT duration_s, {O.r("baseline - version_a", 3)} AS absolute_improvement, CASE WHEN baseline <> 0 THEN
      {O.r("(baseline - version_a) / baseline * 100", 2)} END AS percent_improvement FROM (SELECT duration_s, metric, {_PIVOT} FROM long WHERE metric = 'final_error_m' GROUP BY 1, 2)""",
    "json_report": O.sql("SELECT CAST(count(*) FILTER (WHERE duration_s = 5) AS DOUBLE) AS five, CAST(count(*) FILTER (WHERE duration_s = 30) AS DOUBLE) AS thirty FROM metrics"),
    "error_lines": O.sql(f"SELECT duration_s, t_s - start_s AS elapsed_s, count(*) AS n, {O.r('avg(error_m)', 4)} AS error_m FROM inside GROUP BY 1, 2"),
    "synthetic_drive": f"""WITH p AS (SELECT i, radians(51.4778) + i * 1.0 * cos(radians(45.0)) / 6371000.0 AS la FROM (SELECT unnest(range(600)) AS i))
      SELECT i, {O.r("i * (60.0 / 599)", 8)} AS t_s, {O.r("degrees(la)", 8)} AS gt_lat, {O.r("degrees(radians(-0.0014) + sum(CASE WHEN i = 0 THEN 0.0 ELSE sin(radians(45.0)) / (6371000.0 * cos(la)) END) OVER (ORDER BY i))", 8)} AS gt_lon FROM p""",
}
ORACLES["dr_trajectory_chunked"] = ORACLES["dr_trajectory"]
