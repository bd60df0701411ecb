"""Geodesy and attitude expressions over the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import geo, quat, text
from wayline.operators import stats
from wayline.plans import oracles as O
from wayline.plans.common import r, rounded
from wayline.sources.events import raw_steps

LAT, LON = 51.4778, -0.0014


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """Two attitudes for each event."""
    rows = raw_steps(spark, sf)
    turn = F.col("event_id") * 7 % 170
    p = quat.from_euler_deg(turn, F.col("k") * 0.5 - 20, F.col("value") % 40)
    q = quat.from_euler_deg(turn + 10 + F.col("k") * 0.3, F.col("k") * 0.4 - 15, F.col("value") % 30)
    return rows.select("event_id", "event_type", "k", "value", p.alias("p"), q.alias("q"))


def parts_of(q: str) -> dict[str, Column]:
    return {c: F.col(f"{q}.{c}") for c in "wxyz"}


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return raw_steps(spark, sf).select("event_id", (LAT + F.col("k") / 500).alias("lat"), (LON + F.col("value") / 1000).alias("lon"), "k", "value")


def haversine(spark: SparkSession, sf: str) -> DataFrame:
    args = F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")
    return rounded(_places(spark, sf), ["event_id"], 5, arcsine_m=geo.haversine_m(*args), arctangent_m=geo.haversine_atan2_m(*args))


def enu_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _places(spark, sf).withColumn("e", geo.east_m(F.col("lon"), F.lit(LAT), F.lit(LON))).withColumn("n", geo.north_m(F.col("lat"), F.lit(LAT)))
    back = {"back_lat": geo.enu_to_lat(F.col("n"), F.lit(LAT)), "back_lon": geo.enu_to_lon(F.col("e"), F.lit(LAT), F.lit(LON))}
    return rows.select("event_id", r("e", 5).alias("e"), r("n", 5).alias("n"), *[r(c, 8).alias(n) for n, c in back.items()])


def euler_to_quat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(poses(spark, sf), ["event_id"], **parts_of("p"))


def relative_quat(spark: SparkSession, sf: str) -> DataFrame:
    rows = poses(spark, sf).withColumn("d", quat.relative_xyz(F.col("p"), F.col("q")))
    return rounded(rows, ["event_id"], **{c: F.col(f"d.{c}") for c in "xyz"})


def quat_multiply(spark: SparkSession, sf: str) -> DataFrame:
    rows = poses(spark, sf).withColumn("d", quat.multiply(F.col("p"), F.col("q")))
    return rounded(rows, ["event_id"], **parts_of("d"))


def quat_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """p**-1 * p, the identity."""
    rows = poses(spark, sf).withColumn("i", quat.inverse(F.col("p"))).withColumn("d", quat.multiply(F.col("i"), F.col("p")))
    return rounded(rows, ["event_id"], **parts_of("d"))


def rotvec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_steps(spark, sf).withColumn("d", quat.from_rotvec(F.col("k") / 50, F.col("value") / 200, F.col("event_id") % 7 / 7.0))
    rows = rows.withColumn("v", quat.to_rotvec(F.col("d")))
    return rounded(rows, ["event_id"], **parts_of("d"), vx=F.col("v.x"), vy=F.col("v.y"), vz=F.col("v.z"))


def rotation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = poses(spark, sf).withColumn("m", quat.to_rotmat(F.col("p")))
    return rounded(rows, ["event_id"], **{f"m{i}": F.col("m")[i] for i in range(9)})


def rotmat_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Through the matrix and back: the same attitude."""
    rows = poses(spark, sf).withColumn("m", quat.to_rotmat(F.col("p"))).withColumn("d", quat.from_rotmat(F.col("m")))
    return rounded(rows, ["event_id"], overlap=F.abs(quat.dot(F.col("p"), F.col("d"))))


def heading_quat_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    heading = F.col("event_id") * 7 % 350 + 5.0
    rows = raw_steps(spark, sf).withColumn("d", quat.from_heading_deg(heading)).withColumn("h", quat.to_heading_deg(F.col("d")))
    return rounded(rows, ["event_id"], heading="h")


def angular_error_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = poses(spark, sf).withColumns({"angle": quat.angular_error_deg(F.col("p"), F.col("q")), "loss": quat.cosine_loss(F.col("p"), F.col("q"))})
    found = stats.angle_scores(rows, "angle", "loss", ["event_type"])
    return rounded(found, ["event_type"], 5, **{c: c for c in found.columns if c != "event_type"})


def target_quats(spark: SparkSession, sf: str) -> DataFrame:
    v = F.struct((F.col("k") / 100).alias("x"), (F.col("value") / 400).alias("y"), (F.col("event_id") % 5 / 10.0).alias("z"))
    rows = raw_steps(spark, sf).withColumn("v", v).withColumn("d", quat.from_xyz(F.col("v")))
    return rounded(rows, ["event_id"], **parts_of("d"))


def headings(spark: SparkSession, sf: str) -> DataFrame:
    """Segment bearings and two-way differences."""
    rows = raw_steps(spark, sf)
    bearing = geo.segment_heading_deg((F.lit(0.0), F.lit(0.0)), (F.col("k") + 0.5, F.col("value") - 25.25))
    rows = rows.withColumn("b", bearing)
    return rounded(rows, ["event_id"], 5, bearing="b", difference=geo.heading_difference_deg(F.col("b"), F.col("event_id") % 360))


def distance_texts(spark: SparkSession, sf: str) -> DataFrame:
    metres, seconds = F.col("event_id") * 13 % 4000 + 0.25, F.col("event_id") * 37 % 20000
    return raw_steps(spark, sf).select("event_id", text.distance_text(metres).alias("distance"), text.duration_text(seconds).alias("duration"))


QUERIES = {f.__name__: f for f in (
    haversine, enu_roundtrip, euler_to_quat, relative_quat, quat_multiply, quat_inverse, rotvec_roundtrip, rotation_matrix, rotmat_roundtrip,
    heading_quat_roundtrip, angular_error_stats, target_quats, headings, distance_texts,
)}

_A = "(sin(radians(lat - 51.4778) / 2) ^ 2 + cos(radians(51.4778)) * cos(radians(lat)) * sin(radians(lon - (-0.0014)) / 2) ^ 2)"
_PLACES = ", places AS (SELECT event_id, 51.4778 + k / 500.0 AS lat, -0.0014 + value / 1000 AS lon FROM ev) "
_POSED = f", poses AS ({O.POSES}) "
_PRODUCT = O.quat_product("p", "q")
_TURN = [x.replace("p_x", "(-p_x)").replace("p_y", "(-p_y)").replace("p_z", "(-p_z)") for x in _PRODUCT]
_DOT = "(p_w * q_w + p_x * q_x + p_y * q_y + p_z * q_z)"
_FOUR = lambda cols: ", ".join(f"{O.r(c)} AS {n}" for c, n in zip(cols, "wxyz", strict=True))
_MATRIX = [
    "1 - 2 * (p_y * p_y + p_z * p_z)", "2 * (p_x * p_y - p_w * p_z)", "2 * (p_x * p_z + p_w * p_y)", "2 * (p_x * p_y + p_w * p_z)", "1 - 2 * (p_x * p_x + p_z * p_z)",
    "2 * (p_y * p_z - p_w * p_x)", "2 * (p_x * p_z - p_w * p_y)", "2 * (p_y * p_z + p_w * p_x)", "1 - 2 * (p_x * p_x + p_y * p_y)",
]
_ROT = ", rot AS (SELECT event_id, x, y, z, sqrt(x * x + y * y + z * z) AS a FROM (SELECT event_id, k / 50.0 AS x, value / 200 AS y, event_id % 7 / 7.0 AS z FROM ev)), rot2 AS (SELECT *, cos(a / 2) AS cw, CASE WHEN a < 1e-8 THEN 0.5 ELSE sin(a / 2) / a END AS s FROM rot), rot3 AS (SELECT *, CASE WHEN cw < 0 THEN -1.0 ELSE 1.0 END AS g FROM rot2), rot4 AS (SELECT event_id, g * cw AS w, g * x * s AS x, g * y * s AS y, g * z * s AS z FROM rot3) "
_LEN = "sqrt(x * x + y * y + z * z)"
_VEC = lambda c: f"{O.r(f'{c} * (CASE WHEN {_LEN} < 1e-8 THEN 2.0 ELSE 2 * atan2({_LEN}, w) / {_LEN} END)')} AS v{c}"
ORACLES = {
    "haversine": O.sql(f"{_PLACES} SELECT event_id, {O.r(f'2 * 6371000.0 * asin(least(1.0, sqrt({_A})))', 5)} AS arcsine_m, {O.r(f'2 * 6371000.0 * atan2(sqrt({_A}), sqrt(1 - {_A}))', 5)} AS arctangent_m FROM places"),
    "enu_roundtrip": O.sql(f"{_PLACES} SELECT event_id, {O.r('radians(lon - (-0.0014)) * 6371000.0 * cos(radians(51.4778))', 5)} AS e, {O.r('radians(lat - 51.4778) * 6371000.0', 5)} AS n, {O.r('lat', 8)} AS back_lat, {O.r('lon', 8)} AS back_lon FROM places"),
    "euler_to_quat": O.sql(f"{_POSED} SELECT event_id, {_FOUR(['p_w', 'p_x', 'p_y', 'p_z'])} FROM poses"),
    "relative_quat": O.sql(f"{_POSED} SELECT event_id, " + ", ".join(O.r(f"(CASE WHEN {_TURN[0]} < 0 THEN -1.0 ELSE 1.0 END) * {c}") + f" AS {n}" for c, n in zip(_TURN[1:], "xyz", strict=True)) + " FROM poses"),
    "quat_multiply": O.sql(f"{_POSED} SELECT event_id, {_FOUR(_PRODUCT)} FROM poses"),
    "quat_inverse": O.sql("SELECT event_id, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM ev"),
    "rotvec_roundtrip": O.sql(f"{_ROT} SELECT event_id, {_FOUR(['w', 'x', 'y', 'z'])}, {_VEC('x')}, {_VEC('y')}, {_VEC('z')} FROM rot4"),
    "rotation_matrix": O.sql(f"{_POSED} SELECT event_id, {', '.join(f'{O.r(m)} AS m{i}' for i, m in enumerate(_MATRIX))} FROM poses"),
    "rotmat_roundtrip": O.sql("SELECT event_id, 1.0::DOUBLE AS overlap FROM ev"),
    "heading_quat_roundtrip": O.sql("SELECT event_id, CAST(event_id * 7 % 350 + 5 AS DOUBLE) AS heading FROM ev"),
    "angular_error_stats": O.sql(f"""{_POSED}, angles AS (SELECT event_type, degrees(2 * acos(least(1.0, abs({_DOT})))) AS a, 1 - {_DOT} * {_DOT} AS l FROM poses JOIN ev USING (event_id))
      SELECT event_type, {O.r("avg(a)", 5)} AS mean_deg, {O.r("quantile_cont(a, 0.5)", 5)} AS median_deg, {O.r("quantile_cont(a, 0.9)", 5)} AS p90_deg, {O.r("avg(l)", 5)} AS cosine_loss FROM angles GROUP BY 1"""),
    "target_quats": O.sql(f""", v AS (SELECT event_id, k / 100.0 AS x, value / 400 AS y, event_id % 5 / 10.0 AS z FROM ev), v2 AS (SELECT *, sqrt(greatest(0.0, 1 - x * x - y * y - z * z)) AS w FROM v),
      v3 AS (SELECT *, greatest(1e-12, sqrt(w * w + x * x + y * y + z * z)) AS n FROM v2) SELECT event_id, {_FOUR(["w / n", "x / n", "y / n", "z / n"])} FROM v3"""),
    "headings": O.sql(f""", b AS (SELECT event_id, {O.wrap("degrees(atan2(k + 0.5, value - 25.25))", "360.0")} AS b FROM ev), t AS (SELECT *, abs(b - event_id % 360) % 360.0 AS d FROM b),
      u AS (SELECT *, least(d, 360.0 - d) AS d2 FROM t) SELECT event_id, {O.r("b", 5)} AS bearing, {O.r("least(d2, 180.0 - d2)", 5)} AS difference FROM u"""),
    "distance_texts": O.sql("""SELECT event_id, CASE WHEN m >= 1000 THEN format('{:.1f} km', m / 1000.0) ELSE CAST(CAST(trunc(m) AS BIGINT) AS VARCHAR) || ' m' END AS distance,
      CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' ELSE (s // 60) || ' mins' END AS duration
      FROM (SELECT event_id, event_id * 13 % 4000 + 0.25 AS m, event_id * 37 % 20000 AS s FROM ev)"""),
}
