"""Keyed state for live telemetry: resampling two sensors onto one grid, the outage machine, the online filter.

Rows of a key arrive unsorted within a batch, so each processor sorts them by time first. What is older than what was
already given out is late: it is dropped and counted. A row that says reset clears its key's state, and with `ttl_ms` the
state of a key that has been silent for so long goes by itself.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline.operators.filter_core import RADIUS, Filter, heading_of, heading_quat

GRID_NS, CAPACITY = 100_000_000, 50
#: What one sensor keeps while the other is silent.
HORIZON_NS = 60_000_000_000
_time = itemgetter(0)


SECOND_NS = 1_000_000_000


def valid(values: object) -> bool:
    """Three finite numbers."""
    return values is not None and len(values) == 3 and bool(np.isfinite(np.asarray(values, float)).all())


class RateMeter:
    """Hertz of what is counted, estimated anew whenever at least a second has gone by; the first one starts the clock and
    counts as well."""

    def __init__(self, since: int | None = None, n: int = 0, hz: float = 0.0):
        self.since, self.n, self.hz = since, n, hz

    def tick(self, ts: int) -> float:
        self.n += 1
        if self.since is None:
            self.since = int(ts)
        elif ts - self.since >= SECOND_NS:
            self.hz, self.n, self.since = self.n * SECOND_NS / (ts - self.since), 0, int(ts)
        return self.hz


class Keyed(StatefulProcessor):
    """One value of state for each key."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def held(self, handle: StatefulProcessorHandle, name: str, schema: str):
        return handle.getValueState(name, schema, self.ttl_ms) if self.ttl_ms else handle.getValueState(name, schema)

    def close(self) -> None:
        pass


class Grid:
    """Two sensors' samples interpolated at the times that both have reached; starts at the later first sample.

    A sensor whose partner is silent keeps `horizon` of samples: what is older is let go and counted, and the grid starts
    anew with the partner's next sample, so a key's state stays bounded.
    """

    def __init__(self, step: int = GRID_NS, horizon: int = HORIZON_NS):
        self.step, self.horizon, self.next = step, horizon, None
        self.queues: dict[str, list[tuple[int, list[float]]]] = {"accel": [], "gyro": []}
        self.late, self.let_go = 0, 0

    def add(self, sensor: str, ts: int, values: object) -> Iterator[tuple[int, list[float]]]:
        if sensor not in self.queues or not valid(values):
            return
        queue = self.queues[sensor]
        if queue and ts < queue[-1][0]:
            self.late += 1
            return
        queue.append((int(ts), [float(v) for v in values]))
        accel, gyro = self.queues["accel"], self.queues["gyro"]
        if accel and gyro:
            if self.next is None:
                self.next = max(accel[0][0], gyro[0][0])
            reached = min(accel[-1][0], gyro[-1][0])
            while reached >= self.next:
                yield self.next, self._at(accel) + self._at(gyro)
                self.next += self.step
            for q in (accel, gyro):  # one sample before the next grid time stays, as the next may lie between
                del q[: max(0, bisect_right(q, self.next - self.step, key=_time) - 1)]
        if ts - queue[0][0] > self.horizon:
            gone = bisect_left(queue, ts - self.horizon, key=_time)
            del queue[:gone]
            self.let_go += gone
            if self.next is not None and queue[0][0] > self.next:
                self.next = None
                self.queues["gyro" if sensor == "accel" else "accel"].clear()

    def _at(self, queue: list[tuple[int, list[float]]]) -> list[float]:
        after = min(bisect_left(queue, self.next, key=_time), len(queue) - 1)
        t1, v1 = queue[after]
        if after == 0 or t1 <= self.next:
            return list(v1)
        t0, v0 = queue[after - 1]
        share = (self.next - t0) / (t1 - t0)
        return [a + share * (b - a) for a, b in zip(v0, v1, strict=True)]


RESAMPLED = "device string, ts_ns long, sample array<double>, n long, ready boolean, late long, rate_hz double"
_GRID = "next long, n long, late long, sensors array<string>, times array<long>, samples array<array<double>>, since long, ticks long, hz double"


class Sampled:
    """A device's grid, how many samples it gave, and their rate."""

    def __init__(self, packed: tuple | None = None):
        self.grid, self.n, self.rate = Grid(), 0, RateMeter()
        if packed is not None:
            self.grid.next, self.n, self.grid.late, sensors, times, samples, *rate = packed
            for s, t, v in zip(sensors, times, samples, strict=True):
                self.grid.queues[s].append((t, list(v)))
            self.rate = RateMeter(*rate)

    def add(self, frame: pd.DataFrame) -> Iterator[tuple[int, list[float], float]]:
        """(time, sample, rate) of each grid sample; a reset forgets all."""
        for r in frame.sort_values(["ts_ns", "sensor"]).itertuples():
            if r.sensor == "reset":
                self.grid, self.n, self.rate = Grid(), 0, RateMeter()
                continue
            for ts, sample in self.grid.add(r.sensor, r.ts_ns, r.values if hasattr(r, "values") else None):
                self.n += 1
                yield ts, sample, self.rate.tick(ts)

    def packed(self) -> tuple:
        kept = [(s, t, v) for s, q in self.grid.queues.items() for t, v in q]
        return (self.grid.next, self.n, self.grid.late, *([k[i] for k in kept] for i in range(3)), self.rate.since, self.rate.n, self.rate.hz)


class Resampler(Keyed):
    """Sensor events (sensor accel, gyro or reset) to grid samples; `n` counts them, `ready` says that the last CAPACITY
    make a window, `rate_hz` is the rate of grid samples."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = self.held(handle, "grid", _GRID)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sampled = Sampled(self.state.get() if self.state.exists() else None)
        out = [(key[0], ts, sample, sampled.n, sampled.n >= CAPACITY, sampled.grid.late, hz) for ts, sample, hz in sampled.add(pd.concat(list(rows)))]
        self.state.update(sampled.packed())
        yield pd.DataFrame(out, columns=["device", "ts_ns", "sample", "n", "ready", "late", "rate_hz"])


class Rolling:
    """The last `capacity` samples, given out whole for every sample once full."""

    def __init__(self, capacity: int = CAPACITY, held: list[list[float]] | None = None):
        self.capacity, self.held = capacity, held or []

    def add(self, sample: list[float]) -> list[list[float]] | None:
        self.held = [*self.held, list(sample)][-self.capacity :]
        return self.held if len(self.held) == self.capacity else None


WINDOWS = "device string, ts_ns long, imu array<array<double>>"


class RollingWindows(Keyed):
    """Grid samples to windows of CAPACITY, one for each sample once there are as many. A null sample is a reset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = self.held(handle, "held", "samples array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rolling = Rolling(held=[list(s) for s in self.state.get()[0]] if self.state.exists() else [])
        out = []
        for r in pd.concat(list(rows)).sort_values("ts_ns").itertuples():
            if r.sample is None:
                rolling.held = []
            elif (window := rolling.add(r.sample)) is not None:
                out.append((key[0], r.ts_ns, [list(x) for x in window]))
        self.state.update((rolling.held,))
        yield pd.DataFrame(out, columns=["device", "ts_ns", "imu"])


LIVE_WINDOWS = "device string, ts_ns long, imu array<array<double>>, n long, window_rate_hz double"


class LiveWindows(Keyed):
    """Sensor events straight to the windows that a model reads: the grid, its last CAPACITY samples, and a window for
    every `stride` samples from the first full one on, with the rate of windows."""

    def __init__(self, stride: int = 10, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.stride = stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = self.held(handle, "live", _GRID + ", held array<array<double>>, w_since long, w_ticks long, w_hz double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packed = self.state.get() if self.state.exists() else None
        sampled = Sampled(None if packed is None else packed[:9])
        rolling = Rolling(held=[] if packed is None else [list(s) for s in packed[9]])
        rate, out = RateMeter(*(() if packed is None else packed[10:])), []
        for ts, sample, _ in sampled.add(pd.concat(list(rows))):
            if sampled.n == 1:  # the first, or the first after a reset
                rolling, rate = Rolling(), RateMeter()
            if (window := rolling.add(sample)) is not None and (sampled.n - CAPACITY) % self.stride == 0:
                out.append((key[0], ts, [list(x) for x in window], sampled.n, rate.tick(ts)))
        self.state.update((*sampled.packed(), rolling.held, rate.since, rate.n, rate.hz))
        yield pd.DataFrame(out, columns=["device", "ts_ns", "imu", "n", "window_rate_hz"])


NEWEST_WINDOWS = LIVE_WINDOWS + ", skipped long"


class NewestWindows(LiveWindows):
    """As LiveWindows, but a batch gives only the newest window of a key: whatever is slower than the stream then works
    on what is current instead of falling behind. `skipped` counts the windows left out so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = self.held(handle, "skipped", "skipped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        skipped = self.count.get()[0] if self.count.exists() else 0
        for windows in super().handleInputRows(key, rows, timerValues):
            skipped += max(0, len(windows) - 1)
            self.count.update((skipped,))
            yield windows.tail(1).assign(skipped=skipped)


class Outage:
    """FIX, OUTAGE, RECOVERING and RECOVERED; recovered stays until the next outage."""

    def __init__(self, mode: str = "FIX", since: int = 0, skipped: int = 0):
        self.mode, self.since, self.skipped = mode, since, skipped

    @property
    def hidden(self) -> bool:
        return self.mode == "OUTAGE"

    def command(self, cmd: str, ts: int) -> None:
        if cmd == "start":
            self.mode, self.since, self.skipped = "OUTAGE", int(ts), 0
        elif cmd == "restore":
            self.mode = "RECOVERING"
        elif cmd == "reset":
            self.mode, self.since, self.skipped = "FIX", 0, 0

    def fix(self) -> bool:
        """Whether a fix may be used."""
        if self.hidden:
            self.skipped += 1
            return False
        self.mode = "RECOVERED" if self.mode in ("RECOVERING", "RECOVERED") else "FIX"
        return True


OUTAGES = "device string, ts_ns long, mode string, skipped long, applied boolean"


class OutageMachine(Keyed):
    """Commands (cmd start, restore or reset) and fixes (cmd null) of a device to its mode after each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = self.held(handle, "mode", "mode string, since long, skipped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = Outage(*self.state.get()) if self.state.exists() else Outage()
        out = []
        for r in pd.concat(list(rows)).sort_values("ts_ns", kind="stable").itertuples():
            applied = None
            if isinstance(r.cmd, str) and r.cmd:
                machine.command(r.cmd, r.ts_ns)
            else:
                applied = machine.fix()
            out.append((key[0], r.ts_ns, machine.mode, machine.skipped, applied))
        self.state.update((machine.mode, machine.since, machine.skipped))
        frame = pd.DataFrame(out, columns=["device", "ts_ns", "mode", "skipped", "applied"])
        yield frame.astype({"applied": "boolean"})


TRACK = "device string, ts_ns long, kind string, mode string, lat double, lon double, heading_deg double, speed_ms double, applied boolean"


#: Attitudes remembered for measured rotations, and how far back one reaches.
REMEMBERED, LOOK_BACK_NS = 100, 5_000_000_000


class Tracker:
    """The online filter of one device: started by the first usable fix, moved by each sample, corrected by speeds and
    measured rotations at any time and by fixes outside outages. Impossible measurements are ignored."""

    def __init__(self) -> None:
        self.filter: Filter | None = None
        self.origin, self.last, self.outage = (0.0, 0.0), 0, Outage()
        self.past: list[tuple[int, list[float]]] = []

    def sample(self, ts: int, sample: list[float]) -> None:
        if self.filter is not None and ts > self.last:
            values = np.asarray(sample, float)
            self.filter.predict((ts - self.last) / 1e9, values[:3], values[3:])
            self.filter.hold_to_track()
            self.last = ts
            self.past = [*self.past, (int(ts), self.filter.attitude.tolist())][-REMEMBERED:]

    def speed(self, speed: float) -> None:
        if self.filter is not None and np.isfinite(speed):
            self.filter.take_speed(max(0.0, float(speed)))

    def turn(self, ts: int, relative: list[float]) -> None:
        """A rotation measured since 5 s before, from the remembered attitude nearest to then (the earlier on a tie)."""
        if self.filter is not None and self.past and np.isfinite(np.asarray(relative, float)).all():
            start = min(self.past, key=lambda p: abs(p[0] - (ts - LOOK_BACK_NS)))[1]
            self.filter.take_turn(np.asarray(relative, float), np.asarray(start))

    def fix(self, ts: int, lat: float, lon: float, heading: float | None) -> bool:
        if not (np.isfinite(lat) and np.isfinite(lon)) or not self.outage.fix():
            return False
        if self.filter is None:
            self.filter = Filter(attitude=heading_quat(heading or 0.0), gated=True)
            self.origin, self.last = (lat, lon), ts
            return True
        scale = RADIUS * np.cos(np.radians(self.origin[0]))
        at = [np.radians(lon - self.origin[1]) * scale, np.radians(lat - self.origin[0]) * RADIUS, 0.0]
        return self.filter.take_position(np.array(at))

    def place(self) -> tuple[float, float, float, float]:
        if self.filter is None:
            return (float("nan"),) * 4
        e, n, _ = self.filter.position
        scale = RADIUS * np.cos(np.radians(self.origin[0]))
        speed = float(np.linalg.norm(self.filter.velocity))
        return self.origin[0] + np.degrees(n / RADIUS), self.origin[1] + np.degrees(e / scale), heading_of(self.filter.attitude), speed

    def packed(self) -> tuple:
        o, f = self.outage, self.filter
        numbers = [] if f is None else [*f.position, *f.velocity, *f.attitude, *f.covariance.ravel()]
        times, attitudes = [t for t, _ in self.past], [q for _, q in self.past]
        return ([float(x) for x in numbers], *self.origin, int(self.last), o.mode, int(o.since), int(o.skipped), times, attitudes)

    @classmethod
    def unpacked(cls, numbers, lat, lon, last, mode, since, skipped, times, attitudes) -> Tracker:
        found = cls()
        found.past = [(int(t), list(q)) for t, q in zip(times, attitudes, strict=True)]
        found.origin, found.last, found.outage = (lat, lon), last, Outage(mode, since, skipped)
        if len(numbers):
            x = np.array(numbers, float)
            found.filter = Filter(x[:3], x[3:6], x[6:10], x[10:].reshape(9, 9), gated=True)
        return found


class OnlineFilter(Keyed):
    """What happens to a device (kind sample, speed, turn, fix or command) to its place after each. Columns: kind, cmd, lat,
    lon, heading_deg and sample, which holds the sample's six values, the speed alone, or the rotation's w, x, y, z. Rows of
    a batch are taken in the order of the columns `order`."""

    def __init__(self, ttl_ms: int | None = None, order: tuple[str, ...] = ("ts_ns", "kind")):
        super().__init__(ttl_ms)
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = self.held(handle, "tracker", "numbers array<double>, lat double, lon double, last long, mode string, since long, skipped long, times array<long>, attitudes array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracker = Tracker.unpacked(*self.state.get()) if self.state.exists() else Tracker()
        out = []
        for r in pd.concat(list(rows)).sort_values(self.order, kind="stable").itertuples():
            applied = None
            if r.kind == "sample":
                tracker.sample(int(r.ts_ns), list(r.sample))
            elif r.kind == "speed":
                tracker.speed(float(r.sample[0]))
            elif r.kind == "turn":
                tracker.turn(int(r.ts_ns), list(r.sample))
            elif r.kind == "fix":
                applied = bool(tracker.fix(int(r.ts_ns), r.lat, r.lon, None if pd.isna(r.heading_deg) else float(r.heading_deg)))
            elif r.cmd == "reset":
                tracker = Tracker()
            else:
                tracker.outage.command(r.cmd, r.ts_ns)
            out.append((key[0], r.ts_ns, r.kind, tracker.outage.mode, *tracker.place(), applied))
        self.state.update(tracker.packed())
        names = ["device", "ts_ns", "kind", "mode", "lat", "lon", "heading_deg", "speed_ms", "applied"]
        yield pd.DataFrame(out, columns=names).astype({"applied": "boolean"})


def run_stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, key: str = "device") -> DataFrame:
    """A processor over a stream (RocksDB state store) or, on the same code, over a batch."""
    mode = "processingTime" if getattr(processor, "ttl_ms", None) else "none"  # state goes by the clock
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", mode)
