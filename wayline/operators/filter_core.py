"""A nine-state error-state Kalman filter in numpy: the kernel of the batch and streaming trackers.

Position, velocity (east, north, up) and attitude (body to navigation frame, forward-left-up). Errors are additive in
position and velocity and a rotation vector in the navigation frame in attitude. All arrays may have leading axes: one
object then is as many filters, which move in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

GRAVITY, RADIUS = 9.80665, 6371000.0
#: Initial and process deviations, and measurement deviations or variances.
START_SD = np.repeat([1.0, 0.5, np.radians(2.0)], 3)
ACCEL_SD, GYRO_SD = 0.2, 0.02
NHC_VAR, SPEED_VAR, ATTITUDE_VAR, FIX_VAR = 0.05**2, 0.25**2, np.radians(5.0) ** 2, 1.0
#: What a gated filter ignores: speeds and position residuals beyond these.
MAX_SPEED, MAX_RESIDUAL = 100.0, 1000.0
P, V, A = slice(0, 3), slice(3, 6), slice(6, 9)
_EYE3, _EYE9, _CONJUGATE = np.eye(3), np.eye(9), np.array([1.0, -1, -1, -1])


def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def turned_over(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def cross(v: np.ndarray) -> np.ndarray:
    """The matrix of v x."""
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return out - turned_over(out)


def unit(q: np.ndarray) -> np.ndarray:
    """Unit length with w >= 0; the identity for a quaternion of almost no length."""
    n = np.sqrt((q * q).sum(-1, keepdims=True))
    small = n < 1e-12
    return np.where(small, [1.0, 0, 0, 0], q / np.where(small, 1, np.where(q[..., :1] >= 0, n, -n)))


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    w, v, a, b = p[..., :1], p[..., 1:], q[..., :1], q[..., 1:]
    return np.concatenate([w * a - (v * b).sum(-1, keepdims=True), w * b + a * v + times(cross(v), b)], -1)


def conjugate(q: np.ndarray) -> np.ndarray:
    return unit(q) * _CONJUGATE


def exp(v: np.ndarray) -> np.ndarray:
    """The quaternion of a rotation vector."""
    half = np.sqrt((v * v).sum(-1, keepdims=True)) / 2
    return unit(np.concatenate([np.cos(half), 0.5 * np.sinc(half / np.pi) * v], -1))


def log(q: np.ndarray) -> np.ndarray:
    q = unit(q)
    n = np.sqrt((q[..., 1:] ** 2).sum(-1, keepdims=True))
    small = n < 1e-8
    return q[..., 1:] * np.where(small, 2.0, 2 * np.arctan2(n, q[..., :1]) / np.where(small, 1, n))


def matrix(q: np.ndarray) -> np.ndarray:
    q = unit(q)
    c = cross(q[..., 1:])
    return _EYE3 + 2 * q[..., :1, None] * c + 2 * c @ c


def heading_quat(degrees: np.ndarray | float) -> np.ndarray:
    """Level attitude of a heading: a turn about up by 90 degrees less the heading."""
    half = (np.pi / 2 - np.radians(degrees)) / 2
    zero = np.zeros_like(half)
    return unit(np.stack([np.cos(half), zero, zero, np.sin(half)], -1))


def heading_of(q: np.ndarray) -> np.ndarray:
    forward = matrix(q)[..., 0]
    return np.degrees(np.arctan2(forward[..., 0], forward[..., 1])) % 360.0


@dataclass
class Filter:
    """State and its updates. `gated` (for a single filter) ignores non-finite measurements, impossible speeds and far
    fixes."""

    position: np.ndarray = field(default_factory=lambda: np.zeros(3))
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(3))
    attitude: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))
    covariance: np.ndarray = field(default_factory=lambda: np.diag(START_SD**2))
    gated: bool = False

    @classmethod
    def fleet(cls, attitudes: np.ndarray) -> Filter:
        n = len(attitudes)
        return cls(np.zeros((n, 3)), np.zeros((n, 3)), attitudes, np.tile(np.diag(START_SD**2), (n, 1, 1)))

    def some(self, rows) -> Filter:
        return Filter(self.position[rows], self.velocity[rows], self.attitude[rows], self.covariance[rows])

    def put(self, rows, part: Filter) -> None:
        self.position[rows], self.velocity[rows], self.attitude[rows], self.covariance[rows] = part.position, part.velocity, part.attitude, part.covariance

    def predict(self, dt: np.ndarray | float, force: np.ndarray, rate: np.ndarray) -> None:
        """Move on by dt under a specific force and an angular rate in the body frame; nothing if dt isn't positive."""
        if self.gated and not (np.isfinite(force).all() and np.isfinite(rate).all()):
            return
        dt = np.maximum(np.asarray(dt, float), 0.0)[..., None]
        turned = times(matrix(self.attitude), force)
        gained = turned - [0, 0, GRAVITY]
        self.position = self.position + self.velocity * dt + gained * (dt * dt / 2)
        self.velocity = self.velocity + gained * dt
        self.attitude = unit(product(self.attitude, exp(rate * dt)))
        t = dt[..., None]
        step, noise, lever = np.zeros(self.covariance.shape), np.zeros(self.covariance.shape), cross(turned)
        step += _EYE9
        step[..., P, V], step[..., P, A], step[..., V, A] = _EYE3 * t, lever * (-t * t / 2), lever * -t
        a = ACCEL_SD**2 * t
        noise[..., P, P], noise[..., V, V], noise[..., A, A] = _EYE3 * (a * t * t / 3), _EYE3 * a, _EYE3 * (GYRO_SD**2 * t)
        noise[..., P, V] = noise[..., V, P] = _EYE3 * (a * t / 2)
        self._set_covariance(step @ self.covariance @ turned_over(step) + noise)

    def _set_covariance(self, c: np.ndarray) -> None:
        self.covariance = (c + turned_over(c)) / 2

    def measure(self, residual: np.ndarray, jacobian: np.ndarray, noise: np.ndarray) -> None:
        """Kalman update with the Joseph form, then the error moves into the state."""
        across = self.covariance @ turned_over(jacobian)
        spread = jacobian @ across + noise
        try:
            gain = across @ np.linalg.inv(spread)
        except np.linalg.LinAlgError:
            if self.gated:
                return
            gain = across @ np.linalg.pinv(spread)
        error, keep = times(gain, residual), _EYE9 - gain @ jacobian
        self._set_covariance(keep @ self.covariance @ turned_over(keep) + gain @ noise @ turned_over(gain))
        self.position, self.velocity = self.position + error[..., P], self.velocity + error[..., V]
        self.attitude = unit(product(exp(error[..., A]), self.attitude))

    def _body_velocity(self, rows: slice, wanted: np.ndarray, variance: float) -> None:
        to_body = turned_over(matrix(self.attitude))
        jacobian = np.zeros((*self.velocity.shape[:-1], wanted.shape[-1], 9))
        jacobian[..., V], jacobian[..., A] = to_body[..., rows, :], (to_body @ cross(self.velocity))[..., rows, :]
        self.measure(wanted - times(to_body, self.velocity)[..., rows], jacobian, np.eye(wanted.shape[-1]) * variance)

    def hold_to_track(self, variance: float = NHC_VAR) -> None:
        """A vehicle doesn't move sideways or up in its own frame."""
        self._body_velocity(slice(1, 3), np.zeros(2), variance)

    def take_speed(self, speed: np.ndarray | float, variance: float = SPEED_VAR) -> None:
        if not (self.gated and (not np.isfinite(speed) or abs(speed) > MAX_SPEED)):
            self._body_velocity(slice(0, 1), np.asarray(speed, float)[..., None], variance)

    def take_turn(self, relative: np.ndarray, start: np.ndarray, variance: float = ATTITUDE_VAR) -> None:
        """A measured rotation since the attitude `start`; q and -q mean the same."""
        off = product(conjugate(relative), product(conjugate(start), self.attitude))
        jacobian = np.zeros((*self.position.shape, 9))
        jacobian[..., A] = _EYE3
        self.measure(-times(matrix(self.attitude), log(off)), jacobian, _EYE3 * variance)

    def take_position(self, position: np.ndarray, variance: float = FIX_VAR, hidden: bool = False) -> bool:
        """Whether the fix was used: not while hidden, nor, if gated, when it is not finite or too far."""
        residual = np.asarray(position, float) - self.position
        if hidden or self.gated and (not np.isfinite(residual).all() or np.linalg.norm(residual) > MAX_RESIDUAL):
            return False
        jacobian = np.zeros((*self.position.shape, 9))
        jacobian[..., P] = _EYE3
        self.measure(residual, jacobian, _EYE3 * variance)
        return True


def _turn(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """v x w along the first axis; v may have fewer axes in the middle."""
    a, b, c = v
    out = np.empty((3, *np.broadcast_shapes(v.shape[1:], w.shape[1:])))
    out[0] = b * w[2] - c * w[1]
    out[1] = c * w[0] - a * w[2]
    out[2] = a * w[1] - b * w[0]
    return out


def _quat(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    a, b, c, d = p
    w, x, y, z = q
    out = np.empty((4, *np.broadcast_shapes(p.shape[1:], q.shape[1:])))
    out[0] = a * w - b * x - c * y - d * z
    out[1] = a * x + b * w + c * z - d * y
    out[2] = a * y - b * z + c * w + d * x
    out[3] = a * z + b * y - c * x + d * w
    return out


def _unit(q: np.ndarray) -> np.ndarray:
    """As `unit`, along the first axis: sums over the last of four numbers are slow."""
    n = np.sqrt((q * q).sum(0))
    small = n < 1e-12
    if small.any():
        return unit(q.T).T
    return q / np.where(q[0] >= 0, n, -n)


def _exp(v: np.ndarray) -> np.ndarray:
    """As `exp`, of unit length but for the last digits and of either sign: what it turns is made a unit again."""
    half = np.sqrt((v * v).sum(0)) / 2
    out = np.empty((4, *half.shape))
    out[0] = np.cos(half)
    np.multiply(0.5 * np.sinc(half / np.pi), v, out=out[1:])
    return out


def _added(parts: Iterator[np.ndarray]) -> np.ndarray:
    """The sum of new arrays, in the first of them."""
    total = next(parts)
    for x in parts:
        total += x
    return total


class Fleet:
    """The same filter for many vehicles that move in step, with the vehicle as the last axis of every array.

    Each operation runs along whole rows of numbers, and the blocks of the algebra that are zero or the identity are left out:
    no matrices of one vehicle are multiplied. Covariances change in place; `some` of a slice shares them. An update takes S as the spread of the measurement and K as the gain; with
    K S = C H', the Joseph form is C less K (C H')'.
    """

    def __init__(self, position: np.ndarray, velocity: np.ndarray, attitude: np.ndarray, covariance: np.ndarray):
        self.position, self.velocity, self.attitude, self.covariance = position, velocity, attitude, covariance

    @classmethod
    def level(cls, attitude: np.ndarray) -> Fleet:
        """At the origin with the starting deviations; attitudes as (4, n)."""
        n = attitude.shape[1]
        return cls(np.zeros((3, n)), np.zeros((3, n)), attitude.copy(), np.repeat(np.diag(START_SD**2)[..., None], n, 2))

    def some(self, which) -> Fleet:
        return Fleet(*(a[..., which] for a in (self.position, self.velocity, self.attitude, self.covariance)))

    def put(self, which, part: Fleet) -> None:
        for mine, new in zip((self.position, self.velocity, self.attitude), (part.position, part.velocity, part.attitude), strict=True):
            mine[..., which] = new
        if part.covariance.base is not self.covariance:  # else it was moved where it lies
            self.covariance[..., which] = part.covariance

    def rotation(self) -> np.ndarray:
        w, x, y, z = _unit(self.attitude)
        x2, y2, z2 = x + x, y + y, z + z
        xx, yy, zz, xy, xz, yz, wx, wy, wz = x2 * x, y2 * y, z2 * z, x2 * y, x2 * z, y2 * z, x2 * w, y2 * w, z2 * w
        out = np.empty((3, 3, *w.shape))
        out[0, 0], out[0, 1], out[0, 2] = 1 - (yy + zz), xy - wz, xz + wy
        out[1, 0], out[1, 1], out[1, 2] = xy + wz, 1 - (xx + zz), yz - wx
        out[2, 0], out[2, 1], out[2, 2] = xz - wy, yz + wx, 1 - (xx + yy)
        return out

    def heading(self) -> np.ndarray:
        r = self.rotation()
        return np.degrees(np.arctan2(r[0, 0], r[1, 0])) % 360.0

    def predict(self, dt: np.ndarray, force: np.ndarray, rate: np.ndarray) -> None:
        t = np.maximum(dt, 0.0)
        turned = (self.rotation() * force).sum(1)
        gained = turned.copy()
        gained[2] -= GRAVITY
        self.position = self.position + self.velocity * t + gained * (t * t / 2)
        self.velocity = self.velocity + gained * t
        self.attitude = _unit(_quat(self.attitude, _exp(rate * t)))
        c = self.covariance
        lever = _turn(turned, c[A]) * t  # on the rows of attitude
        rows_p, rows_v = c[P] + c[V] * t - lever * (t / 2), c[V] - lever
        u = turned[:, None]
        pa, va, a = rows_p[:, A], rows_v[:, A], ACCEL_SD**2 * t
        lever = _turn(u, pa.swapaxes(0, 1)).swapaxes(0, 1) * t  # on the columns
        pv = rows_p[:, V] - lever
        pp = rows_p[:, P] + rows_p[:, V] * t - lever * (t / 2)
        vv = rows_v[:, V] - _turn(u, va.swapaxes(0, 1)).swapaxes(0, 1) * t
        c[P, P], c[V, V] = (pp + pp.swapaxes(0, 1)) / 2, (vv + vv.swapaxes(0, 1)) / 2
        c[P, V], c[P, A], c[V, A] = pv, pa, va
        for i in range(3):
            c[i, i] += a * t * t / 3
            c[3 + i, 3 + i] += a
            c[6 + i, 6 + i] += GYRO_SD**2 * t
            c[i, 3 + i] += a * t / 2
        c[V, P], c[A, P], c[A, V] = c[P, V].swapaxes(0, 1), pa.swapaxes(0, 1), va.swapaxes(0, 1)

    def _measure(self, residual: np.ndarray, across: np.ndarray, spread: np.ndarray) -> None:
        """Residual (m, n), C H' (9, m, n), and S (m, m, n) of 1 to 3 values; a filter whose S has no inverse stays as it is."""
        m, s = len(residual), spread
        if m == 1:
            d = s[0, 0]
            adjugate = [[np.ones_like(d)]]
        elif m == 2:
            d = s[0, 0] * s[1, 1] - s[0, 1] * s[1, 0]
            adjugate = [[s[1, 1], -s[0, 1]], [-s[1, 0], s[0, 0]]]
        else:
            cofactor = lambda i, j: s[(i + 1) % 3, (j + 1) % 3] * s[(i + 2) % 3, (j + 2) % 3] - s[(i + 1) % 3, (j + 2) % 3] * s[(i + 2) % 3, (j + 1) % 3]
            adjugate = [[cofactor(j, i) for j in range(3)] for i in range(3)]
            d = s[0, 0] * adjugate[0][0] + s[0, 1] * adjugate[1][0] + s[0, 2] * adjugate[2][0]
        d = np.where(d == 0, np.inf, d)
        inverse = [[x / d for x in row] for row in adjugate]
        weighted = lambda j: (across[:, k] * inverse[k][j] for k in range(m))
        gain = [_added(weighted(j)) for j in range(m)]
        error = _added(gain[j] * residual[j] for j in range(m))
        # Row by row from the diagonal on, the rest mirrored: an array of all entries at once no longer fits the cache.
        c = self.covariance
        for i in range(9):
            c[i, i:] -= _added(gain[j][i] * across[i:, j] for j in range(m))
            c[i + 1 :, i] = c[i, i + 1 :]
        self.position, self.velocity = self.position + error[P], self.velocity + error[V]
        self.attitude = _unit(_quat(_exp(error[A]), self.attitude))

    def _body_velocity(self, rows: tuple[int, ...], wanted: np.ndarray | float, variance: float) -> None:
        to_body = self.rotation().swapaxes(0, 1)
        c, across, spread, residual = self.covariance, [], [], []
        jacobian = [(to_body[i], _turn(to_body[i], self.velocity)) for i in rows]  # b' [v x] is (b x v)'
        for i, (v, a) in zip(rows, jacobian, strict=True):
            across.append(np.einsum("ijn,jn->in", c[:, V], v) + np.einsum("ijn,jn->in", c[:, A], a))
            residual.append(wanted - (to_body[i] * self.velocity).sum(0))
        for j, (v, a) in enumerate(jacobian):
            spread.append(np.stack([(v * x[V]).sum(0) + (a * x[A]).sum(0) + (variance if j == k else 0.0) for k, x in enumerate(across)]))
        self._measure(np.stack(residual), np.stack(across, 1), np.stack(spread))

    def hold_to_track(self, variance: float = NHC_VAR) -> None:
        self._body_velocity((1, 2), 0.0, variance)

    def take_speed(self, speed: np.ndarray, variance: float = SPEED_VAR) -> None:
        self._body_velocity((0,), speed, variance)

    def _direct(self, part: slice, residual: np.ndarray, variance: float) -> None:
        spread = self.covariance[part, part].copy()
        for i in range(3):
            spread[i, i] += variance
        self._measure(residual, self.covariance[:, part].copy(), spread)

    def take_turn(self, relative: np.ndarray, start: np.ndarray, variance: float = ATTITUDE_VAR) -> None:
        inverse = lambda q: _unit(q) * _CONJUGATE[:, None]
        off = log(_quat(inverse(relative), _quat(inverse(start), self.attitude)).T).T
        self._direct(A, -(self.rotation() * off).sum(1), variance)

    def take_position(self, position: np.ndarray, variance: float = FIX_VAR) -> None:
        self._direct(P, position - self.position, variance)
