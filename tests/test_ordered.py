import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.plans import live
from wayline.streaming import ordered as OR
from wayline.streaming.processors import CAPACITY, GRID_NS, Grid, Rolling, Tracker
from wayline.streaming.run import drained

S = 1_000_000_000


def rows_of(spark, rows):
    """rows: (device, second, arrival)."""
    full = [(d, int(t * S), "fix", None, 51.0, 0.0, None, None, a) for d, t, a in rows]
    return spark.createDataFrame(full, f"device string, ts_ns long, {OR.PAYLOAD}, arrival long")


def test_shuffled_rows_come_sorted_and_late_ones_are_marked(spark):
    rng = np.random.default_rng(3)
    rows = [(d, t, int(t + rng.integers(0, 8))) for d in "abcdefgh" for t in range(60)]
    held = [(d, 2.5, 1000) for d in "abcd"]
    plan = lambda s: OR.in_order(s.drop("arrival"))
    found = drained(rows_of(spark, rows + held), plan, 4, "arrival", OR.end_of_stream(spark)).collect()
    assert sorted((r["device"], r["ts_ns"]) for r in found if not r["late"]) == sorted((d, t * S) for d, t, _ in rows)
    assert sorted((r["device"], r["ts_ns"] / S) for r in found if r["late"]) == [(d, 2.5) for d in "abcd"]
    # What an earlier release gave is never newer than what a later one gives.
    for d in "abcdefgh":
        own = sorted(((r["ts"], r["ts_ns"]) for r in found if r["device"] == d and not r["late"]))
        assert [t for _, t in own] == sorted(t for _, t in own) and len({ts for ts, _ in own}) > 1


def test_a_device_far_ahead_makes_no_row_of_another_late(spark):
    """Each device is ordered by its own clock, whatever the others' rows let the watermark pass."""
    rows = [(d, t, t + t * 5 % 8) for d, n in (("fast", 400), ("slow", 40), ("slower", 24)) for t in range(n)]
    found = drained(rows_of(spark, rows), lambda s: OR.in_order(s.drop("arrival")), 4, "arrival", OR.end_of_stream(spark)).collect()
    assert len(found) == len(rows) and not any(r["late"] for r in found)


def test_a_silent_sensor_keeps_a_bounded_queue():
    grid = Grid()
    for i in range(20_000):  # 200 s at 100 Hz, the other sensor silent
        assert not list(grid.add("accel", i * 10_000_000, [float(i), 0.0, 0.0]))
    assert len(grid.queues["accel"]) <= 6001 and grid.let_go == 20_000 - len(grid.queues["accel"])
    out = list(grid.add("gyro", 199 * S, [0.0, 0.0, 1.0]))
    assert [t for t, _ in out] == [199 * S] and out[0][1][0] == 19_900.0
    # Both go on, then the gyro is silent and comes back: the grid starts anew there.
    for i in range(100):
        out += list(grid.add("gyro", 199 * S + i * 20_000_000, [0.0, 0.0, 1.0])) + list(grid.add("accel", 200 * S + i * 20_000_000, [0.0, 0.0, 0.0]))
    for i in range(9000):
        assert not list(grid.add("accel", 210 * S + i * 10_000_000, [0.0, 0.0, 0.0])) or i == 0
    assert len(grid.queues["accel"]) <= 6001 and not grid.queues["gyro"] and grid.next is None
    again = list(grid.add("gyro", 299 * S + 500_000_000, [0.0, 0.0, 2.0]))
    assert [t for t, _ in again] == [299 * S + 500_000_000] and again[0][1][5] == 2.0


def test_grid_keeps_the_bracket_of_sparse_samples():
    """Samples a second apart: every grid time between them is interpolated."""
    grid, out = Grid(), []
    for i in range(5):
        for sensor in ("accel", "gyro"):
            out += grid.add(sensor, i * S, [float(i), 0.0, 0.0])
    assert [t for t, _ in out] == [i * GRID_NS for i in range(41)]
    assert all(abs(v[0] - t / S) < 1e-9 and abs(v[3] - t / S) < 1e-9 for t, v in out)


def replayed(rows, speed):
    """The loop of one device over its sorted rows, in plain Python: last place, fixes used, measurements taken."""
    grid, rolling, tracker, n, fixes, measured, after = Grid(), Rolling(), Tracker(), 0, 0, 0, {}

    def note(ts, kind):
        after[ts, kind] = (tracker.place(), tracker.outage.mode)

    for r in sorted(rows, key=lambda r: (r["ts_ns"], r["kind"])):
        if r["kind"] in ("accel", "gyro"):
            for ts, sample in grid.add(r["kind"], r["ts_ns"], r["sample"]):
                n += 1
                tracker.sample(ts, sample)
                note(ts, "sample")
                if (window := rolling.add(sample)) is not None and (n - CAPACITY) % 10 == 0:
                    angle = sum(x[5] for x in window) * 0.1
                    tracker.speed(speed(window))
                    note(ts, "speed")
                    tracker.turn(ts, [np.cos(angle / 2), 0.0, 0.0, np.sin(angle / 2)])
                    note(ts, "turn")
                    measured += 1
        elif r["kind"] == "fix":
            fixes += tracker.fix(r["ts_ns"], r["lat"], r["lon"], r["heading_deg"])
            note(r["ts_ns"], "fix")
        else:
            tracker.outage.command(r["cmd"], r["ts_ns"])
            note(r["ts_ns"], "command")
    place, mode = after[max(after)]
    return place, fixes, measured, mode


def test_closed_loop_is_the_plain_replay(spark, data):
    by = {}
    for r in live.loop_rows(spark, data).collect():
        by.setdefault(r["device"], []).append(r)
    found = {r["device"]: r for r in live.stream_closed_loop(spark, data).collect()}
    assert found.keys() == by.keys() and sum(r["turns"] for r in found.values()) > 100
    for device, rows in by.items():
        (lat, lon, _, speed), fixes, measured, mode = replayed(rows, lambda w: 5 + sum(x[2] for x in w) / CAPACITY - 9.80665)
        got = found[device]
        assert (got["fixes"], got["speeds"], got["turns"], got["mode"]) == (fixes, measured, measured, mode), device
        assert abs(got["lat"] - lat) < 2e-7 and abs(got["lon"] - lon) < 2e-7 and abs(got["speed_ms"] - speed) < 2e-4


def test_a_window_is_summed_once_and_samples_are_no_rows(spark, data):
    """The turn's sum is one expression, not one for each mention of it; what goes from the windows to the filter has a row
    for many samples, and several windows."""
    spark.range(1).select(F.lit([1.0] * 300).alias("imu")).createOrReplaceTempView("imus")
    plan = spark.table("imus").select(OR.turn_over(F.col("imu")).alias("q"))
    assert plan._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    frame = live.loop_rows(spark, data).drop("arrival").toPandas().sort_values(["device", "ts_ns", "kind"], ignore_index=True)
    given = pd.concat(list(OR.windowed({}, frame, 10)), ignore_index=True)
    plain = ~frame["kind"].isin(["accel", "gyro"])
    samples = [pickle.loads(b) for b in given["block"].dropna()]
    assert sum(len(t) for _, _, t, *_ in samples) > 5000 and len(given) <= plain.sum() + len(samples) + frame["device"].nunique() * 2
    assert (given["kind"] == "window").sum() * 4 < sum(len(t) for t in given["times"].dropna())


def test_the_last_rows_are_the_tracks_last(spark, data):
    rows, end = live.loop_rows(spark, data), OR.end_of_stream(spark)
    track = drained(rows, lambda s: OR.closed_loop(s.drop("arrival"), live.window_speed()), 3, "arrival", end)
    newest = F.max_by(F.struct("kind", "mode", "lat", "lon", "heading_deg", "speed_ms"), F.struct("ts_ns", "kind"))
    kind = F.col("kind")
    wanted = track.groupBy("device").agg(F.max("ts_ns").alias("ts_ns"), newest.alias("x"), F.count_if("applied").alias("fixes"), F.count_if(kind == "speed").alias("speeds"), F.count_if(kind == "turn").alias("turns"))
    found = drained(rows, lambda s: OR.closed_loop(s.drop("arrival"), live.window_speed(), last=True), 3, "arrival", end)
    found = found.groupBy("device").agg(F.max("ts_ns").alias("ts_ns"), newest.alias("x"), *[F.sum(c).alias(c) for c in ("fixes", "speeds", "turns")])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("speed", [2.0, 9.0])
def test_the_estimate_follows_the_windows(spark, speed):
    """A vehicle that stands by its readings moves as fast as its windows' answers say, once fixes stop."""
    rows = [("d", int(i * S // 10), k, None, None, None, None, v, i) for i in range(400) for k, v in (("accel", [0.0, 0.0, 9.80665]), ("gyro", [0.0, 0.0, 0.0]))]
    rows += [("d", 0, "fix", None, 51.0, 0.0, 0.0, None, 0)]
    df = spark.createDataFrame(rows, f"device string, ts_ns long, {OR.PAYLOAD}, arrival long")
    found = drained(df, lambda s: OR.closed_loop(s.drop("arrival"), F.lit(speed)), 2, "arrival", OR.end_of_stream(spark))
    last = found.orderBy(F.desc("ts_ns")).first()
    north = np.radians(last["lat"] - 51.0) * 6371000.0
    assert abs(last["speed_ms"] - speed) < 0.2 and 0.7 * 35 * speed < north < 1.1 * 40 * speed
