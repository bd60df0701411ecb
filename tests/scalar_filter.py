"""One session filtered step by step on rotation matrices: a second, plain form of the filter to hold the first against."""

import math

import numpy as np

from wayline.operators import filter_core as C


def skew(v):
    x, y, z = v
    return np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]], float)


def rotation(v):
    """Rodrigues' formula."""
    angle = math.sqrt(float(np.dot(v, v)))
    if angle < 1e-12:
        return np.eye(3) + skew(v)
    k = skew(v / angle)
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def vector(r):
    """The rotation vector of a rotation of less than half a turn."""
    sin = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    s, c = float(np.linalg.norm(sin)), (np.trace(r) - 1) / 2
    return sin if s < 1e-12 else sin * (math.atan2(s, c) / s)


def of_quaternion(q):
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ])


def level(heading_deg):
    yaw = math.radians(90 - heading_deg)
    return np.array([[math.cos(yaw), -math.sin(yaw), 0], [math.sin(yaw), math.cos(yaw), 0], [0, 0, 1.0]])


class Scalar:
    def __init__(self, heading_deg):
        self.p, self.v, self.r, self.c = np.zeros(3), np.zeros(3), level(heading_deg), np.diag(C.START_SD.astype(float) ** 2)

    def predict(self, dt, force, rate):
        f = self.r @ force
        a = f - np.array([0, 0, C.GRAVITY])
        self.p, self.v = self.p + self.v * dt + a * dt * dt / 2, self.v + a * dt
        self.r = self.r @ rotation(np.asarray(rate, float) * dt)
        step, noise, eye = np.eye(9), np.zeros((9, 9)), np.eye(3)
        step[0:3, 3:6], step[0:3, 6:9], step[3:6, 6:9] = eye * dt, -skew(f) * dt * dt / 2, -skew(f) * dt
        q = C.ACCEL_SD**2
        noise[0:3, 0:3], noise[3:6, 3:6], noise[6:9, 6:9] = eye * q * dt**3 / 3, eye * q * dt, eye * C.GYRO_SD**2 * dt
        noise[0:3, 3:6] = noise[3:6, 0:3] = eye * q * dt**2 / 2
        self.c = step @ self.c @ step.T + noise

    def update(self, residual, h, variance):
        n = np.eye(len(residual)) * variance
        gain = np.linalg.solve(h @ self.c @ h.T + n, h @ self.c).T
        keep = np.eye(9) - gain @ h
        self.c = keep @ self.c @ keep.T + gain @ n @ gain.T
        e = gain @ residual
        self.p, self.v, self.r = self.p + e[0:3], self.v + e[3:6], rotation(e[6:9]) @ self.r

    def body(self, rows, wanted, variance):
        h = np.zeros((len(rows), 9))
        h[:, 3:6], h[:, 6:9] = self.r.T[rows], (self.r.T @ skew(self.v))[rows]
        self.update(np.array(wanted) - (self.r.T @ self.v)[rows], h, variance)

    def turn(self, relative, start, variance):
        h = np.zeros((3, 9))
        h[:, 6:9] = np.eye(3)
        self.update(-self.r @ vector(of_quaternion(relative).T @ start.T @ self.r), h, variance)

    def fix(self, place, variance):
        h = np.zeros((3, 9))
        h[:, 0:3] = np.eye(3)
        self.update(np.array(place) - self.p, h, variance)

    def heading(self):
        return math.degrees(math.atan2(self.r[0, 0], self.r[1, 0])) % 360


def run(rows, use, roads=None):
    """rows of one session and schedule in order, as dictionaries; roads: interval -> [(ax, ay, bx, by)]. (e, n, heading,
    outcome) after each step."""
    first = rows[0]
    f, scale = Scalar(first["gt_heading_deg"]), C.RADIUS * math.cos(math.radians(first["gt_lat"]))
    past, out = [(first["t_s"], f.r.copy())], [(0.0, 0.0, f.heading(), None)]
    for before, row in zip(rows, rows[1:], strict=False):
        dt = row["t_s"] - before["t_s"]
        dt = dt if dt > 0 else 1.0
        for sample in row["imu"]:
            f.predict(dt / len(row["imu"]), np.array(sample[:3]), np.array(sample[3:6]))
        if use.speed:
            f.body([0], [max(0.0, row["speed_ms"])], use.speed_var)
        if use.track:
            f.body([1, 2], [0.0, 0.0], C.NHC_VAR)
        if use.turn and row["rel_q"] is not None:
            f.turn(row["rel_q"], min(past, key=lambda p: abs(p[0] - (row["t_s"] - 5.0)))[1], use.turn_var)
        past.append((row["t_s"], f.r.copy()))
        if not row["is_blackout"]:
            f.fix([math.radians(row["gt_lon"] - first["gt_lon"]) * scale, math.radians(row["gt_lat"] - first["gt_lat"]) * C.RADIUS, 0.0], use.fix_var)
        outcome = None
        if roads is not None and row["is_blackout"] and row["interval_idx"] is not None:
            outcome = "no_road"
            best = None
            for ax, ay, bx, by in roads.get(row["interval_idx"], []):
                square = (bx - ax) ** 2 + (by - ay) ** 2
                t = 0.0 if square < 1e-12 else min(1.0, max(0.0, ((f.p[0] - ax) * (bx - ax) + (f.p[1] - ay) * (by - ay)) / square))
                x, y = ax + t * (bx - ax), ay + t * (by - ay)
                d = math.hypot(f.p[0] - x, f.p[1] - y)
                if best is None or d < best[0]:
                    best = d, x, y, math.degrees(math.atan2(bx - ax, by - ay)) % 360
            if best is not None:
                off = abs(f.heading() - best[3])
                off = min(off, 360 - off)
                if best[0] > use.gates.max_distance_m:
                    outcome = "distance"
                elif min(off, 180 - off) > use.gates.max_heading_deg:
                    outcome = "heading"
                else:
                    outcome, s = "matched", use.gates.strength
                    f.fix([f.p[0] + s * (best[1] - f.p[0]), f.p[1] + s * (best[2] - f.p[1]), f.p[2]], use.road_var)
        out.append((float(f.p[0]), float(f.p[1]), f.heading(), outcome))
    return out
