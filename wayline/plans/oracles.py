"""Building blocks of the DuckDB oracles: the same definitions as the Spark plans, as common table expressions."""

from __future__ import annotations


def r(x: str, n: int = 6) -> str:
    """Rounded, with one zero."""
    return f"CASE WHEN abs({x}) < 5e-{n + 1} THEN 0.0 ELSE round({x}, {n}) END"


PI2 = "(2 * pi())"


def wrap(x: str, whole: str = PI2) -> str:
    return f"(({x}) - {whole} * floor(({x}) / {whole}))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(sin(radians({lat2} - ({lat1})) / 2) ^ 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - ({lon1})) / 2) ^ 2)"
    return f"(2 * 6371000.0 * asin(least(1.0, sqrt{a})))"


DURATIONS = (5, 10, 30, 60)

PRELUDE = f"""WITH ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, ts, event_id,
    event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
raw AS (
  SELECT session_id, i, CAST(i AS DOUBLE) AS t_s, ts, event_id, event_type, value, k, 5 + value / 50 AS true_speed,
    5 + value / 50 + (event_id % 7 - 3) / 10.0 AS speed_ms, (k - 50) / 1000.0 AS true_gyro, (k - 50) / 1000.0 + 0.002 AS gyro_z,
    value / 100 AS accel_x, (k - 50) / 100.0 AS accel_y, 9.80665 + (event_id % 5 - 2) / 100.0 AS accel_z,
    CASE WHEN i = 0 THEN 0.0 ELSE 1.0 END AS dt FROM ev),
true_h AS (
  SELECT *, {wrap("sum(true_gyro * dt) OVER (PARTITION BY session_id ORDER BY i)")} AS th FROM raw),
true_lat AS (
  SELECT *, radians(51.4778) + sum(true_speed * dt / 6371000.0 * cos(th)) OVER (PARTITION BY session_id ORDER BY i) AS glat FROM true_h),
true_lag AS (SELECT *, lag(glat) OVER (PARTITION BY session_id ORDER BY i) AS plat FROM true_lat),
steps AS (
  SELECT *, degrees(glat) AS gt_lat, degrees(th) AS gt_heading_deg, degrees(radians(-0.0014) + sum(CASE WHEN i = 0 THEN 0.0 ELSE
    true_speed * dt / 6371000.0 * sin(th) / cos(plat) END) OVER (PARTITION BY session_id ORDER BY i)) AS gt_lon FROM true_lag),
lengths AS (SELECT session_id, max(t_s) AS total_s FROM raw GROUP BY session_id),
durations AS (SELECT unnest([5, 10, 30, 60]) AS duration_s),
fractions AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS f),
spread AS (
  SELECT session_id, duration_s, CAST(trunc(f * total_s) AS DOUBLE) AS start_s, total_s FROM lengths, durations, fractions
    WHERE total_s > duration_s + 10.0 AND trunc(f * total_s) + duration_s < total_s - 2.0
  UNION ALL
  SELECT session_id, duration_s, greatest(1.0, trunc((total_s - duration_s) / 2.0)) AS start_s, total_s FROM lengths, durations
    WHERE total_s <= duration_s + 10.0),
intervals AS (
  SELECT session_id, duration_s, CAST(row_number() OVER (PARTITION BY session_id, duration_s ORDER BY start_s) - 1 AS INT) AS interval_idx,
    start_s, start_s + duration_s AS end_s FROM spread),
variants AS (
  SELECT s.*, d.duration_s, (i > 0 AND EXISTS (SELECT 1 FROM intervals v WHERE v.session_id = s.session_id AND v.duration_s = d.duration_s
    AND s.t_s BETWEEN v.start_s AND v.end_s)) AS is_blackout FROM steps s, durations d
  WHERE EXISTS (SELECT 1 FROM intervals v WHERE v.session_id = s.session_id AND v.duration_s = d.duration_s)),
est_h AS (
  SELECT *, {wrap("radians(first_value(gt_heading_deg) OVER w) + sum(gyro_z * dt) OVER w")} AS h, (i = 0 OR NOT is_blackout) AS fix
  FROM variants WINDOW w AS (PARTITION BY session_id, duration_s ORDER BY i)),
runs AS (SELECT *, sum(CASE WHEN fix THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, duration_s ORDER BY i) AS run FROM est_h),
est_lat AS (
  SELECT *, radians(first_value(gt_lat) OVER w) + sum(CASE WHEN fix THEN 0.0 ELSE speed_ms * dt / 6371000.0 * cos(h) END) OVER w AS elat
  FROM runs WINDOW w AS (PARTITION BY session_id, duration_s, run ORDER BY i)),
est_lag AS (SELECT *, lag(elat) OVER (PARTITION BY session_id, duration_s ORDER BY i) AS eplat FROM est_lat),
est AS (
  SELECT *, degrees(elat) AS lat, degrees(radians(first_value(gt_lon) OVER w) + sum(CASE WHEN fix THEN 0.0 ELSE
    speed_ms * dt / 6371000.0 * sin(h) / cos(eplat) END) OVER w) AS lon
  FROM est_lag WINDOW w AS (PARTITION BY session_id, duration_s, run ORDER BY i)),
errors AS (SELECT *, {haversine("lat", "lon", "gt_lat", "gt_lon")} AS error_m FROM est),
inside AS (
  SELECT e.*, v.interval_idx, v.start_s, v.end_s FROM errors e JOIN intervals v USING (session_id, duration_s)
  WHERE e.t_s BETWEEN v.start_s AND v.end_s),
inside_d AS (SELECT *, speed_ms * (lead(t_s) OVER (PARTITION BY session_id, duration_s, interval_idx ORDER BY i) - t_s) AS d FROM inside),
metrics0 AS (
  SELECT session_id, duration_s, interval_idx, start_s, end_s, arg_max(error_m, i) AS final_error_m, max(error_m) AS max_error_m,
    sqrt(avg(error_m * error_m)) AS rmse_error_m, coalesce(sum(d), 0.0) AS traveled_distance_m, count(*) AS points_count
  FROM inside_d GROUP BY ALL),
metrics AS (
  SELECT *, CASE WHEN traveled_distance_m > 1e-3 THEN final_error_m / traveled_distance_m * 100.0 ELSE 0.0 END AS relative_drift_percent FROM metrics0),
windows AS (
  SELECT session_id, CAST((i - 49) / 10 AS BIGINT) AS window_idx, count(*) OVER f AS n, avg(gyro_z) OVER f AS gyro_mean,
    first_value(t_s) OVER f AS start_s, t_s AS end_s, true_speed, i, sum(accel_x) OVER f AS ax, sum(accel_y) OVER f AS ay, sum(accel_z) OVER f AS az
  FROM raw WINDOW f AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
count_windows AS (SELECT * FROM windows WHERE i >= 49 AND (i - 49) % 10 = 0)
"""


def sql(body: str) -> str:
    return PRELUDE + body


def quat_product(p: str, q: str) -> list[str]:
    """Components of p * q over columns p_w ... q_z."""
    a, b, c, d = (f"{p}_{x}" for x in "wxyz")
    w, x, y, z = (f"{q}_{x}" for x in "wxyz")
    return [
        f"({a} * {w} - {b} * {x} - {c} * {y} - {d} * {z})", f"({a} * {x} + {b} * {w} + {c} * {z} - {d} * {y})",
        f"({a} * {y} - {b} * {z} + {c} * {w} + {d} * {x})", f"({a} * {z} + {b} * {y} - {c} * {x} + {d} * {w})",
    ]


def euler(yaw: str, pitch: str, roll: str, into: str) -> str:
    cy, sy, cp, sp, cr, sr = (f"{f}(radians({a}) / 2)" for a in (yaw, pitch, roll) for f in ("cos", "sin"))
    return (
        f"{cr} * {cp} * {cy} + {sr} * {sp} * {sy} AS {into}_w, {sr} * {cp} * {cy} - {cr} * {sp} * {sy} AS {into}_x, "
        f"{cr} * {sp} * {cy} + {sr} * {cp} * {sy} AS {into}_y, {cr} * {cp} * {sy} - {sr} * {sp} * {cy} AS {into}_z"
    )


#: Two attitudes for each event, away from sign changes.
POSES = f"""SELECT event_id, {euler("event_id * 7 % 170", "k * 0.5 - 20", "value % 40", "p")},
  {euler("event_id * 7 % 170 + 10 + k * 0.3", "k * 0.4 - 15", "value % 30", "q")} FROM ev"""
