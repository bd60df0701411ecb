import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayline.streaming import processors as P
from wayline.streaming.processors import GRID_NS, Grid, Outage, RateMeter, Rolling, Tracker, valid
from wayline.streaming.run import drained

MS = 1_000_000


def test_grid_interpolates_both():
    grid, out = Grid(), []
    for i in range(26):  # 50 Hz over 500 ms
        for sensor in ("accel", "gyro"):
            out += grid.add(sensor, i * 20 * MS, [i * 20 / 200, 0.0, 1.0])
    assert [t for t, _ in out] == [i * GRID_NS for i in range(6)]
    assert abs(out[1][1][0] - 0.5) < 1e-9 and abs(out[1][1][3] - 0.5) < 1e-9


def test_grid_starts_at_the_later_first_and_waits():
    grid, out = Grid(), []
    out += grid.add("accel", 0, [0.0, 0, 0])
    out += grid.add("gyro", 50 * MS, [0.0, 0, 0])
    assert not out
    out += grid.add("accel", 100 * MS, [10.0, 0, 0])
    assert out == [(50 * MS, [5.0, 0, 0, 0, 0, 0])]
    out += grid.add("accel", 30 * MS, [1.0, 0, 0])
    assert grid.late == 1 and len(out) == 1


def test_bad_samples():
    assert valid([1, 2, 3]) and not valid([1, 2]) and not valid([1, math.nan, 3]) and not valid([1, math.inf, 3]) and not valid(None)


def test_rolling_window():
    rolling, windows = Rolling(), []
    for i in range(80):
        if (w := rolling.add([float(i)])) is not None:
            windows.append(w)
    assert len(windows) == 31 and windows[-1][0] == [30.0] and windows[-1][-1] == [79.0]


def test_outage_machine():
    m = Outage()
    assert m.fix() and m.mode == "FIX"
    m.command("start", 1)
    assert not m.fix() and not m.fix() and (m.mode, m.skipped) == ("OUTAGE", 2)
    m.command("restore", 2)
    assert m.mode == "RECOVERING" and m.fix() and m.mode == "RECOVERED"
    assert m.fix() and m.mode == "RECOVERED"
    m.command("start", 3)
    assert m.skipped == 0


def test_tracker_survives_packing():
    a = Tracker()
    assert a.fix(0, 51.0, 0.0, 0.0)
    for i in range(1, 20):
        a.sample(i * GRID_NS, [0.5, 0, 9.80665, 0, 0, 0])
        if i % 5 == 0:
            a.fix(i * GRID_NS, 51.0 + i * 1e-6, 0.0, None)
        b = Tracker.unpacked(*a.packed())
        assert b.place() == a.place()
        a = b
    a.speed(3.0)
    a.turn(20 * GRID_NS, [1.0, 0, 0, 0])
    assert len(a.past) == 19 and a.place()[3] > 0.5
    a.speed(math.nan)
    before = a.place()
    a.outage.command("start", 0)
    assert not a.fix(9 * GRID_NS, 52.0, 1.0, None) and a.place() == before
    assert not a.fix(9 * GRID_NS, math.nan, 1.0, None)


def test_stream_matches_batch(spark, data):
    from wayline.plans.streams import resample_counts, stream_resample

    rows = {r["device"]: r["samples"] for r in stream_resample(spark, data).collect()}
    assert rows == {r["device"]: r["samples"] for r in resample_counts(spark, data).collect()}


def test_rate_meter():
    meter = RateMeter()
    rates = [meter.tick(i * GRID_NS) for i in range(32)]
    assert rates[:10] == [0.0] * 10 and rates[10:20] == [11.0] * 10 and rates[20:] == [10.0] * 12
    meter = RateMeter()
    assert [meter.tick(t * P.SECOND_NS) for t in (0, 3, 4)] == [0.0, 2 / 3, 1.0]


def events(n, reset=None):
    rows = []
    for i in range(n):
        rows += [("accel", i * GRID_NS, [float(i), 0.0, 9.8]), ("gyro", i * GRID_NS, [0.0, 0.0, i / 10])]
    if reset is not None:
        rows.append(("reset", reset * GRID_NS + 1, None))
    return pd.DataFrame(rows, columns=["sensor", "ts_ns", "values"])


def test_reset_forgets_the_grid():
    sampled = P.Sampled()
    plain = list(P.Sampled().add(events(30)))
    out = list(sampled.add(events(30, reset=14)))
    assert [t for t, *_ in plain] == [i * GRID_NS for i in range(30)] and len(out) == 30
    assert sampled.n == 15 and sampled.rate.n < 12  # counted anew from the first after the reset
    again = P.Sampled(sampled.packed())
    assert (again.n, again.grid.next, again.rate.since) == (sampled.n, sampled.grid.next, sampled.rate.since)
    m = Outage("OUTAGE", 5, 3)
    m.command("reset", 9)
    assert (m.mode, m.skipped) == ("FIX", 0)


def streamed(spark, rows, processor, schema, kind):
    frame = spark.createDataFrame(rows, kind)
    return drained(frame, lambda s: P.run_stateful(s, processor, schema)).collect()


SENSORS = "device string, sensor string, ts_ns long, values array<float>"


def test_live_windows_over_batches(spark):
    """State goes over from batch to batch: the windows are those of one pass, and a reset starts them anew."""
    both = [(d, s, int(t), None if v is None else [float(x) for x in v]) for d, reset in (("a", None), ("b", 69)) for s, t, v in events(120, reset).itertuples(index=False)]
    rows = streamed(spark, both, P.LiveWindows(), P.LIVE_WINDOWS, SENSORS)
    a, b = ([r for r in sorted(rows, key=lambda r: r["ts_ns"]) if r["device"] == d] for d in "ab")
    assert [r["n"] for r in a] == [50, 60, 70, 80, 90, 100, 110, 120] and [x[0] for x in a[3]["imu"]] == [float(i) for i in range(30, 80)]
    assert [r["window_rate_hz"] for r in a[:3]] == [0.0, 2.0, 1.0]
    assert [r["n"] for r in b] == [50, 60, 70, 50] and b[-1]["imu"][0][0] == 70.0


def test_rolling_windows_on_a_stream(spark):
    rows = [("a", i * GRID_NS, [float(i)] * 6) for i in range(70)] + [("b", i * GRID_NS, None if i == 10 else [float(i)] * 6) for i in range(62)]
    found = streamed(spark, rows, P.RollingWindows(), P.WINDOWS, "device string, ts_ns long, sample array<double>")
    assert sum(r["device"] == "a" for r in found) == 21 and sum(r["device"] == "b" for r in found) == 2
    last = max((r for r in found if r["device"] == "a"), key=lambda r: r["ts_ns"])
    assert [x[0] for x in last["imu"]] == [float(i) for i in range(20, 70)]


def test_the_session_keeps_its_settings(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    streamed(spark, [("a", 0, "start")], P.OutageMachine(), P.OUTAGES, "device string, ts_ns long, cmd string")
    assert spark.conf.get(name, None) == before


def test_stream_filter_is_the_tracker(spark, data):
    """The streaming query against one pass of plain rows through a tracker of scalar steps."""
    from tests.scalar_filter import Scalar
    from wayline.operators.filter_core import FIX_VAR, NHC_VAR, RADIUS, SPEED_VAR
    from wayline.plans.streams import stream_filter
    from wayline.sources.events import raw_steps

    wanted = {}
    sessions = {}
    for r in raw_steps(spark, data).select("session_id", "i", "accel_z", "gyro_z").collect():
        sessions.setdefault(r["session_id"], []).append(r)
    for device, rows in sessions.items():
        f, applied, hidden, mode, last = None, 0, False, "FIX", None
        for r in sorted(rows, key=lambda r: r["i"]):
            # Of one time: commands, then fixes, samples and speeds.
            if r["i"] % 40 in (20, 30):
                hidden = r["i"] % 40 == 20
                mode = "OUTAGE" if hidden else "RECOVERING"
            if not hidden:
                mode = "RECOVERED" if mode in ("RECOVERING", "RECOVERED") else "FIX"
                north = math.radians(51.4778 + r["i"] * 5e-5 - 51.4778) * RADIUS
                if f is None:
                    f, applied = Scalar(0.0), applied + 1
                elif np.linalg.norm(np.array([0.0, north, 0.0]) - f.p) <= 1000:
                    f.fix([0.0, north, 0.0], FIX_VAR)
                    applied += 1
            if last is not None:
                f.predict(float(r["i"] - last), np.array([0, 0, r["accel_z"]]), np.array([0, 0, -r["gyro_z"]]))
                f.body([1, 2], [0.0, 0.0], NHC_VAR)
            last = r["i"]
            f.body([0], [5.56], SPEED_VAR)
        wanted[device] = (applied, mode, 51.4778 + math.degrees(f.p[1] / RADIUS), float(np.linalg.norm(f.v)))
    found = {r["device"]: r for r in stream_filter(spark, data).collect()}
    assert found.keys() == wanted.keys()
    for device, (applied, mode, lat, speed) in wanted.items():
        r = found[device]
        assert (r["applied"], r["mode"]) == (applied, mode) and abs(r["lat"] - lat) < 2e-6 and abs(r["speed_ms"] - speed) < 2e-3
