"""Roads from past fixes, matching, and progress along a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import blackout as B
from wayline.operators import roads as R
from wayline.plans import oracles as O
from wayline.plans.common import event_intervals, r, rounded, tracked
from wayline.sources.events import true_steps

KEYS = ["session_id", "duration_s", "interval_idx"]


def _fixes(spark: SparkSession, sf: str) -> DataFrame:
    steps = true_steps(spark, sf).select("session_id", "i", "t_s", "gt_lat", "gt_lon")
    return steps.withColumns({"ref_lat": F.lit(51.4778), "ref_lon": F.lit(-0.0014)})


def _roads(spark: SparkSession, sf: str) -> DataFrame:
    return R.past_roads(_fixes(spark, sf), event_intervals(spark, sf))


def _road_points(spark: SparkSession, sf: str) -> DataFrame:
    """Tracked points inside outages, in metres and set off by a few, with a heading away from the seam."""
    points, intervals = tracked(spark, sf)
    inside = B.members(points, intervals)
    ref = F.lit(51.4778), F.lit(-0.0014)
    off = (F.col("event_id") % 9 - 4) * 3.0
    return inside.select(*KEYS, "i", (geo.east_m(F.col("lon"), *ref) + off).alias("e"), (geo.north_m(F.col("lat"), ref[0]) - off / 2).alias("n"), (F.degrees("heading_rad") + 0.37).alias("heading_deg"))


def road_from_lookback(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_roads(spark, sf), [*KEYS, "vertex"], 5, e="e", n="n")


def road_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Roads from all fixes before each outage, as ranges of each session's polyline."""
    _, ranges = R.road_ranges(_fixes(spark, sf), event_intervals(spark, sf), lookback_s=0.0)
    return rounded(ranges, [*KEYS, "first_vertex", "last_vertex", "n_vertices"], 4, length_m="length_m")


def road_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices on a coarse grid, where a session stands still now and then."""
    vertices = _fixes(spark, sf).select("session_id", F.col("i").alias("seq"), (F.floor(F.col("t_s") / 3) * 2.0).alias("e"), (F.floor(F.col("t_s") / 4) * 1.0).alias("n"))
    return R.kept_vertices(vertices, ["session_id"]).select("session_id", "seq", "vertex", "e", "n")


def polyline_segments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.segments(_roads(spark, sf), KEYS), [*KEYS, "segment_idx"], 5, ax="ax", ay="ay", bx="bx", by="by")


def nearest_segment(spark: SparkSession, sf: str) -> DataFrame:
    """With no gate but a very wide one, the nearest segment's distance."""
    found = R.match(_road_points(spark, sf), R.segments(_roads(spark, sf), KEYS), KEYS, R.Gates(1e9, 90.0, 0.0))
    return rounded(found.where("matched"), [*KEYS, "i"], 4, distance_m="distance_m")


def map_match(spark: SparkSession, sf: str) -> DataFrame:
    found = R.match(_road_points(spark, sf), R.segments(_roads(spark, sf), KEYS), KEYS)
    return rounded(found, [*KEYS, "i", "matched", "outcome", "rejection_reason"], 3, corr_e="corr_e", corr_n="corr_n")


def match_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = R.match_stats(R.match(_road_points(spark, sf), R.segments(_roads(spark, sf), KEYS), KEYS), KEYS)
    exact = [*KEYS, "n_steps", "n_matched", "n_rejected_distance", "n_rejected_heading"]
    return rounded(found, exact, 4, match_fraction="match_fraction", avg_correction_m="avg_correction_m", max_correction_m="max_correction_m")


def match_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Both means of the correction by duration: over steps, and over intervals' means."""
    each = R.match_stats(R.match(_road_points(spark, sf), R.segments(_roads(spark, sf), KEYS), KEYS), KEYS)
    steps = R.rolled_up(each, ["duration_s"])
    means = R.rolled_up(each, ["duration_s"], by_step=False).select("duration_s", F.col("avg_correction_m").alias("mean_of_means_m"))
    exact = ["duration_s", "n_steps", "n_matched", "n_rejected_distance", "n_rejected_heading"]
    return rounded(steps.join(means, "duration_s"), exact, 4, match_fraction="match_fraction", avg_correction_m="avg_correction_m", mean_of_means_m="mean_of_means_m")


def route_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as routes of their true places; positions of all steps, a little off."""
    steps = true_steps(spark, sf)
    points = steps.select(F.col("session_id").alias("route_id"), F.col("i").alias("seq"), F.col("gt_lat").alias("lat"), F.col("gt_lon").alias("lon"))
    at = steps.select(F.col("session_id").alias("route_id"), "i", (F.col("gt_lat") + 1e-5).alias("lat"), (F.col("gt_lon") + 2e-5).alias("lon"))
    found = R.route_progress(at, points)
    return found.select("route_id", "i", r("remaining_m", 3).alias("remaining_m"), "percent", "progress_text")


QUERIES = {f.__name__: f for f in (
    road_from_lookback, road_ranges, road_dedupe, polyline_segments, nearest_segment, map_match, match_stats, match_rollup, route_progress,
)}

_ROAD = f""", looked AS (
  SELECT v.session_id, v.duration_s, v.interval_idx, s.i, radians(s.gt_lon - (-0.0014)) * 6371000.0 * cos(radians(51.4778)) AS e, radians(s.gt_lat - 51.4778) * 6371000.0 AS n
  FROM steps s JOIN intervals v USING (session_id) WHERE s.t_s < v.start_s AND s.t_s >= v.start_s - 120.0),
gaps AS (
  SELECT *, count(*) OVER (PARTITION BY session_id, duration_s, interval_idx) AS raw_n, sqrt((e - lag(e) OVER w) ^ 2 + (n - lag(n) OVER w) ^ 2) AS gap
  FROM looked WINDOW w AS (PARTITION BY session_id, duration_s, interval_idx ORDER BY i)),
kept AS (
  SELECT *, CAST(row_number() OVER w - 1 AS INT) AS vertex, lag(e) OVER w AS pe, lag(n) OVER w AS pn FROM gaps WHERE raw_n >= 3 AND (gap IS NULL OR gap > 0.1)
  WINDOW w AS (PARTITION BY session_id, duration_s, interval_idx ORDER BY i)),
sized AS (
  SELECT *, count(*) OVER p AS kept_n, coalesce(sum(sqrt((e - pe) ^ 2 + (n - pn) ^ 2)) OVER p, 0.0) AS road_m FROM kept WINDOW p AS (PARTITION BY session_id, duration_s, interval_idx)),
road AS (SELECT session_id, duration_s, interval_idx, vertex, e, n FROM sized WHERE kept_n >= 3 AND road_m >= 1.0),
segs0 AS (
  SELECT session_id, duration_s, interval_idx, vertex AS segment_idx, e AS ax, n AS ay, lead(e) OVER w AS bx, lead(n) OVER w AS by_
  FROM road WINDOW w AS (PARTITION BY session_id, duration_s, interval_idx ORDER BY vertex)),
segs AS (SELECT * FROM segs0 WHERE bx IS NOT NULL),
pts AS (
  SELECT session_id, duration_s, interval_idx, i, radians(lon - (-0.0014)) * 6371000.0 * cos(radians(51.4778)) + (event_id % 9 - 4) * 3.0 AS e,
    radians(lat - 51.4778) * 6371000.0 - (event_id % 9 - 4) * 3.0 / 2 AS n, degrees(h) + 0.37 AS heading FROM inside),
near0 AS (
  SELECT p.*, g.segment_idx, g.ax, g.ay, g.bx, g.by_, (g.bx - g.ax) ^ 2 + (g.by_ - g.ay) ^ 2 AS sq FROM pts p LEFT JOIN segs g USING (session_id, duration_s, interval_idx)),
near1 AS (SELECT *, CASE WHEN sq < 1e-12 THEN 0.0 ELSE greatest(0.0, least(1.0, ((e - ax) * (bx - ax) + (n - ay) * (by_ - ay)) / sq)) END AS t FROM near0),
near2 AS (SELECT *, ax + t * (bx - ax) AS x, ay + t * (by_ - ay) AS y FROM near1),
near3 AS (
  SELECT *, sqrt((e - x) ^ 2 + (n - y) ^ 2) AS d, row_number() OVER (PARTITION BY session_id, duration_s, interval_idx, i ORDER BY sqrt((e - x) ^ 2 + (n - y) ^ 2), segment_idx) AS rn FROM near2),
near4 AS (SELECT *, abs({O.wrap("heading", "360.0")} - {O.wrap("degrees(atan2(bx - ax, by_ - ay))", "360.0")}) AS a FROM near3 WHERE rn = 1),
near5 AS (SELECT *, least(a, 360 - a) AS a2 FROM near4),
found AS (
  SELECT *, CASE WHEN d IS NULL THEN 'no_road' WHEN d > 20 THEN 'distance' WHEN least(a2, 180 - a2) > 30 THEN 'heading' ELSE 'matched' END AS outcome FROM near5),
corrected AS (
  SELECT *, outcome = 'matched' AS matched, CASE WHEN outcome = 'matched' THEN e + 0.5 * (x - e) ELSE e END AS corr_e, CASE WHEN outcome = 'matched' THEN n + 0.5 * (y - n) ELSE n END AS corr_n FROM found),
moved AS (SELECT *, CASE WHEN matched THEN sqrt((corr_e - e) ^ 2 + (corr_n - n) ^ 2) END AS m FROM corrected),
tallied AS (
  SELECT session_id, duration_s, interval_idx, count(*) AS n_steps, count(*) FILTER (WHERE matched) AS n_matched, count(*) FILTER (WHERE outcome = 'distance') AS n_rejected_distance,
    count(*) FILTER (WHERE outcome = 'heading') AS n_rejected_heading, coalesce(avg(m), 0.0) AS avg_correction_m, coalesce(max(m), 0.0) AS max_correction_m FROM moved GROUP BY 1, 2, 3)
"""  # fmt: skip
_K = "session_id, duration_s, interval_idx"
_DIST = lambda a, b, c, d: f"(2 * 6371000.0 * atan2(sqrt({_half(a, b, c, d)}), sqrt(greatest(0.0, 1 - {_half(a, b, c, d)}))))"
_half = lambda a, b, c, d: f"(sin(radians({c} - {a}) / 2) ^ 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ^ 2)"
_REASON = """CASE outcome WHEN 'no_road' THEN 'no road polyline provided' WHEN 'distance' THEN format('distance {:.1f}m exceeds max_match_dist_m (20.0m)', d)
  WHEN 'heading' THEN format('heading diff {:.1f}deg exceeds max_heading_diff_deg (30.0deg)', least(a2, 180 - a2)) ELSE '' END"""
ORACLES = {
    "road_from_lookback": O.sql(f"{_ROAD} SELECT {_K}, vertex, {O.r('e', 5)} AS e, {O.r('n', 5)} AS n FROM road"),
    "road_ranges": O.sql(f"""{_ROAD.replace(" AND s.t_s >= v.start_s - 120.0", "")} SELECT {_K}, 0 AS first_vertex, CAST(kept_n - 1 AS INT) AS last_vertex, CAST(kept_n AS INT) AS n_vertices,
      {O.r("max(road_m)", 4)} AS length_m FROM sized WHERE kept_n >= 3 AND road_m >= 1.0 GROUP BY {_K}, kept_n"""),
    "road_dedupe": O.sql("""SELECT session_id, seq, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INT) AS vertex, e, n FROM (
      SELECT *, lag(e) OVER w AS pe, lag(n) OVER w AS pn FROM (SELECT session_id, i AS seq, floor(t_s / 3) * 2.0 AS e, floor(t_s / 4) * 1.0 AS n FROM raw)
      WINDOW w AS (PARTITION BY session_id ORDER BY seq)) WHERE pe IS NULL OR sqrt((e - pe) ^ 2 + (n - pn) ^ 2) > 0.1"""),
    "polyline_segments": O.sql(f"{_ROAD} SELECT {_K}, segment_idx, {', '.join(f'{O.r(c, 5)} AS {c.rstrip(chr(95))}' for c in ('ax', 'ay', 'bx', 'by_'))} FROM segs"),
    "nearest_segment": O.sql(f"{_ROAD} SELECT {_K}, i, {O.r('d', 4)} AS distance_m FROM near4 WHERE d IS NOT NULL"),
    "map_match": O.sql(f"{_ROAD} SELECT {_K}, i, matched, outcome, {_REASON} AS rejection_reason, {O.r('corr_e', 3)} AS corr_e, {O.r('corr_n', 3)} AS corr_n FROM corrected"),
    "match_stats": O.sql(f"""{_ROAD} SELECT {_K}, n_steps, n_matched, n_rejected_distance, n_rejected_heading, {O.r("n_matched / n_steps", 4)} AS match_fraction,
      {O.r("avg_correction_m", 4)} AS avg_correction_m, {O.r("max_correction_m", 4)} AS max_correction_m FROM tallied"""),
    "match_rollup": O.sql(f"""{_ROAD} SELECT duration_s, CAST(sum(n_steps) AS BIGINT) AS n_steps, CAST(sum(n_matched) AS BIGINT) AS n_matched, CAST(sum(n_rejected_distance) AS BIGINT) AS n_rejected_distance,
      CAST(sum(n_rejected_heading) AS BIGINT) AS n_rejected_heading, {O.r("sum(n_matched) / sum(n_steps)", 4)} AS match_fraction,
      {O.r("coalesce(sum(avg_correction_m * n_matched) / nullif(sum(n_matched), 0), 0.0)", 4)} AS avg_correction_m, {O.r("avg(avg_correction_m)", 4)} AS mean_of_means_m FROM tallied GROUP BY 1"""),
    "route_progress": O.sql(f""", pts AS (SELECT session_id AS route_id, i AS seq, gt_lat AS lat, gt_lon AS lon FROM steps),
      nexts AS (SELECT *, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
      pieces AS (SELECT *, coalesce({_DIST("lat", "lon", "nlat", "nlon")}, 0.0) AS piece FROM nexts),
      rest AS (SELECT *, sum(piece) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS to_end, sum(piece) OVER (PARTITION BY route_id) AS total FROM pieces),
      spots AS (SELECT session_id AS route_id, i, gt_lat + 1e-5 AS alat, gt_lon + 2e-5 AS alon FROM steps),
      away AS (SELECT a.route_id, a.i, r.seq, r.to_end, r.total, {_DIST("alat", "alon", "lat", "lon")} AS d FROM spots a JOIN rest r USING (route_id)),
      best AS (SELECT *, row_number() OVER (PARTITION BY route_id, i ORDER BY d, seq) AS rn FROM away),
      rem AS (SELECT route_id, i, total, CASE WHEN total <= 0 THEN 0.0 ELSE least(total, greatest(0.0, d + to_end)) END AS m FROM best WHERE rn = 1),
      pct AS (SELECT *, CASE WHEN total <= 0 THEN 100 ELSE CAST(trunc((total - m) / total * 100) AS INT) END AS percent FROM rem)
      SELECT route_id, i, {O.r("m", 3)} AS remaining_m, percent, CASE WHEN total <= 0 THEN 'Progress: 100%' ELSE 'Progress: ' || percent || '% (Rem: ' ||
        CASE WHEN m >= 1000 THEN format('{{:.1f}} km', m / 1000.0) ELSE CAST(CAST(trunc(m) AS BIGINT) AS VARCHAR) || ' m' END || ')' END AS progress_text FROM pct"""),
}
