"""Quaternions as STRUCT<w, x, y, z> Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.cast("double").alias("w"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def parts(q: Column) -> tuple[Column, Column, Column, Column]:
    return q["w"], q["x"], q["y"], q["z"]


def identity() -> Column:
    return quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))


def _norm(q: Column) -> Column:
    w, x, y, z = parts(q)
    return F.sqrt(w * w + x * x + y * y + z * z)


def _scaled(q: Column, s: Column) -> Column:
    w, x, y, z = parts(q)
    return quat(w * s, x * s, y * s, z * s)


def _once(q: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of q with q worked out once: a nested expression would else be repeated for every mention of it."""
    return F.transform(F.array(q), use)[0]


def normalize(q: Column) -> Column:
    """Unit length with w >= 0; the identity for a quaternion of almost no length."""

    def unit(v: Column) -> Column:
        n = _norm(v)
        return F.when(n < 1e-12, identity()).otherwise(_scaled(v, F.when(v["w"] < 0, -1.0).otherwise(1.0) / n))

    return _once(q, unit)


def multiply(p: Column, q: Column) -> Column:
    """Hamilton product."""
    (a, b, c, d), (w, x, y, z) = parts(p), parts(q)
    return quat(
        a * w - b * x - c * y - d * z,
        a * x + b * w + c * z - d * y,
        a * y - b * z + c * w + d * x,
        a * z + b * y - c * x + d * w,
    )


def inverse(q: Column) -> Column:
    """Conjugate of the normalised quaternion."""
    return _once(normalize(q), lambda n: quat(n["w"], -n["x"], -n["y"], -n["z"]))


def from_euler_deg(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Z-Y-X angles in degrees; unit length."""
    (cy, sy), (cp, sp), (cr, sr) = ((F.cos(F.radians(a) / 2), F.sin(F.radians(a) / 2)) for a in (yaw, pitch, roll))
    return quat(
        cr * cp * cy + sr * sp * sy,
        sr * cp * cy - cr * sp * sy,
        cr * sp * cy + sr * cp * sy,
        cr * cp * sy - sr * sp * cy,
    )


def relative_xyz(start: Column, end: Column) -> Column:
    """Vector part of start**-1 * end with w >= 0."""
    w, x, y, z = parts(start)
    r = multiply(quat(w, -x, -y, -z), end)
    sign = F.when(r["w"] < 0, -1.0).otherwise(1.0)
    return F.struct((r["x"] * sign).alias("x"), (r["y"] * sign).alias("y"), (r["z"] * sign).alias("z"))


def from_xyz(v: Column) -> Column:
    """The unit quaternion whose vector part is v, w rebuilt as not negative."""
    w = F.sqrt(F.greatest(F.lit(0.0), 1 - v["x"] * v["x"] - v["y"] * v["y"] - v["z"] * v["z"]))
    q = quat(w, v["x"], v["y"], v["z"])
    return _scaled(q, 1 / F.greatest(_norm(q), F.lit(1e-12)))


def from_rotvec(x: Column, y: Column, z: Column) -> Column:
    """Exponential map; a series below 1e-8 radians."""
    angle = F.sqrt(x * x + y * y + z * z)
    small = angle < 1e-8
    w = F.when(small, 1 - angle * angle / 8).otherwise(F.cos(angle / 2))
    s = F.when(small, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
    return normalize(quat(w, x * s, y * s, z * s))


def to_rotvec(q: Column) -> Column:
    """Logarithm map as STRUCT<x, y, z>."""

    def vector(n: Column) -> Column:
        length = F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])
        s = F.when(length < 1e-8, F.lit(2.0)).otherwise(2 * F.atan2(length, n["w"]) / length)
        return F.struct((n["x"] * s).alias("x"), (n["y"] * s).alias("y"), (n["z"] * s).alias("z"))

    return _once(normalize(q), vector)


def to_rotmat(q: Column) -> Column:
    """Row-major 3x3 rotation as an array of 9."""

    def rows(n: Column) -> Column:
        w, x, y, z = parts(n)
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return _once(normalize(q), rows)


def from_rotmat(r: Column) -> Column:
    """From a row-major 3x3 rotation, dividing by the largest of the four components."""
    return _once(r, _from_rows)


def _from_rows(r: Column) -> Column:
    m = [[r[3 * i + j] for j in range(3)] for i in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]

    def case(i: int, j: int, k: int) -> Column:
        s = F.sqrt(F.greatest(F.lit(1e-24), 1 + m[i][i] - m[j][j] - m[k][k])) * 2
        part = {i: s / 4, j: (m[i][j] + m[j][i]) / s, k: (m[i][k] + m[k][i]) / s}
        return quat((m[k][j] - m[j][k]) / s, part[0], part[1], part[2])

    s = F.sqrt(F.greatest(F.lit(1e-24), 1 + trace)) * 2
    by_w = quat(s / 4, (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s)
    found = (
        F.when(trace > 0, by_w)
        .when((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), case(0, 1, 2))
        .when(m[1][1] > m[2][2], case(1, 2, 0))
        .otherwise(case(2, 0, 1))
    )
    return normalize(found)


def from_heading_deg(heading: Column, pitch: Column | None = None, roll: Column | None = None) -> Column:
    """Forward-left-up body to east-north-up frame; the heading turns clockwise from north, so yaw is 90 - heading."""
    level = F.lit(0.0)
    return normalize(from_euler_deg(90 - heading, level if pitch is None else pitch, level if roll is None else roll))


def to_heading_deg(q: Column) -> Column:
    """Heading of the body's forward axis, clockwise from north, in [0, 360)."""

    def bearing(n: Column) -> Column:
        w, x, y, z = parts(n)
        return F.pmod(F.degrees(F.atan2(1 - 2 * (y * y + z * z), 2 * (x * y + w * z))), F.lit(360.0))

    return _once(normalize(q), bearing)


def dot(p: Column, q: Column) -> Column:
    (a, b, c, d), (w, x, y, z) = parts(p), parts(q)
    return a * w + b * x + c * y + d * z


def angular_error_deg(p: Column, q: Column) -> Column:
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot(p, q)))))


def cosine_loss(p: Column, q: Column) -> Column:
    d = dot(p, q)
    return 1 - d * d
