import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import scalar_filter
from tests.test_outages import drive, outages
from wayline.operators import blackout as B
from wayline.operators import filter_batch as FB
from wayline.operators.filter_core import Filter, Fleet, conjugate, heading_of, heading_quat, product
from wayline.operators.roads import segments
from wayline.plans import filters
from wayline.plans.common import event_intervals

G = 9.80665


def test_standing_still():
    f = Filter()
    for _ in range(10):
        f.predict(0.1, np.array([0, 0, G]), np.zeros(3))
    assert np.abs(np.r_[f.position, f.velocity]).max() < 1e-5


def test_forward_acceleration():
    f = Filter(attitude=heading_quat(0))
    f.predict(0.5, np.array([2.0, 0, G]), np.zeros(3))
    assert np.allclose(f.velocity, [0, 1, 0], atol=1e-9) and np.allclose(f.position, [0, 0.25, 0], atol=1e-9)
    f.predict(0.0, np.ones(3), np.ones(3))
    assert np.allclose(f.velocity, [0, 1, 0], atol=1e-9)


def test_positive_rate_turns_left():
    f = Filter(attitude=heading_quat(90))
    f.predict(1.0, np.array([0, 0, G]), np.array([0, 0, 0.1]))
    assert abs(heading_of(f.attitude) - (90 - np.degrees(0.1))) < 1e-6


def test_speed_and_fix():
    f = Filter(attitude=heading_quat(0), covariance=np.eye(9))
    f.take_speed(10.0, 0.01)
    assert f.velocity[1] > 5 and abs(f.velocity[0]) < 1e-6
    f = Filter()
    assert f.take_position(np.array([10.0, 20, 0]), 0.01) and np.allclose(f.position[:2], [10, 20], atol=0.5)
    before = f.position.copy()
    assert not f.take_position(np.array([99.0, 99, 0]), hidden=True) and (f.position == before).all()


def test_turn_as_expected_changes_nothing():
    start, now = heading_quat(40), heading_quat(15)
    for sign in (1, -1):
        f = Filter(attitude=now.copy())
        f.take_turn(sign * product(conjugate(start), now), start)
        assert np.allclose(f.attitude, now, atol=1e-12) and np.allclose(f.position, 0)


def test_long_run_stays_sound():
    rng, f = np.random.default_rng(42), Filter()
    for _ in range(100):
        f.predict(0.1, np.array([0, 0, G]) + rng.normal(0, 0.3, 3), rng.normal(0, 0.02, 3))
        f.take_speed(5.0)
        f.hold_to_track()
    assert np.isfinite(f.position).all() and np.allclose(f.covariance, f.covariance.T) and np.linalg.eigvalsh(f.covariance).min() > 0


@pytest.mark.parametrize("position", [[np.nan, 0, 0], [50000.0, 0, 0]])
def test_gates(position):
    f = Filter(gated=True)
    assert not f.take_position(np.array(position))
    f.take_speed(500.0)
    f.predict(0.1, np.array([np.nan, 0, 0]), np.zeros(3))
    assert (f.velocity == 0).all() and (f.position == 0).all()


def test_a_fleet_is_as_many_filters():
    """Vehicles on the last axis, each block of the algebra by itself, against the plain matrices."""
    rng, n = np.random.default_rng(5), 40
    plain = Filter.fleet(heading_quat(rng.uniform(0, 360, n)))
    fleet = Fleet.level(plain.attitude.T)
    for _ in range(30):
        dt, force, rate, speed = rng.uniform(-0.02, 0.2, n), rng.normal(size=(n, 3)) + [0, 0, G], rng.normal(size=(n, 3)) / 10, rng.uniform(0, 10, n)
        turn, start, place = rng.normal(size=(n, 4)) + [5, 0, 0, 0], plain.attitude.copy(), rng.normal(size=(n, 3))
        for f, cast in ((plain, lambda a: a), (fleet, lambda a: a.T)):
            f.predict(dt, cast(force), cast(rate))
            f.take_speed(speed)
            f.hold_to_track()
            f.take_turn(cast(turn), cast(start))
            f.take_position(cast(place), 0.01)
    assert np.allclose(fleet.position.T, plain.position, atol=1e-10) and np.allclose(fleet.attitude.T, plain.attitude, atol=1e-10)
    assert np.allclose(np.moveaxis(fleet.covariance, -1, 0), plain.covariance, atol=1e-10)


def test_the_start_of_a_turn_where_clocks_stand_still():
    assert FB._turn_starts(np.arange(12.0)).tolist() == [0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6]
    assert FB._turn_starts(np.array([0.0, 4, 4, 9, 9, 14])).tolist() == [0, 0, 0, 1, 1, 3]


def ready(spark, pairs, **kind):
    steps = drive(spark, 25, **kind).withColumn("accel_z", F.lit(G))
    return FB.event_steps(B.in_outage(steps, outages(spark, *pairs)))


def test_recovers_after_the_outage(spark):
    points = B.position_errors(FB.run_filter(ready(spark, [(10, 15)])))
    rows = {r["i"]: r for r in points.collect()}
    assert len(rows) == 26 and rows[20]["error_m"] < 5
    assert [i for i in sorted(rows) if rows[i]["is_blackout"]] == list(range(10, 16))


def test_road_pulls_the_track(spark):
    steps = ready(spark, [(10, 20)], bias=0.0).withColumn("gyro_z", F.lit(0.0))
    drift = steps.withColumn("imu", F.array_repeat(F.array(*[F.lit(x) for x in (0.0, 0.0, G, 0.0, 0.0, 0.01)]), 10))
    road = spark.createDataFrame([("s", 1, 0, 0, 0.0, 0.0), ("s", 1, 0, 1, 0.0, 500.0)], "session_id string, duration_s int, interval_idx int, vertex int, e double, n double")
    keys = ["session_id", "duration_s", "interval_idx"]
    free = {r["i"]: abs(r["e"]) for r in FB.run_filter(drift).collect()}
    held = {r["i"]: r for r in FB.run_filter_on_roads(drift, segments(road, keys)).collect()}
    assert abs(held[20]["e"]) < free[20] and held[15]["road_outcome"] == "matched" and held[5]["road_outcome"] is None


@pytest.mark.parametrize("name", ["ekf_version_a", "ekf_version_b_road", "ekf_ablation"])
def test_all_schedules_are_run(spark, data, name):
    keys = ["session_id", "duration_s"] if name != "ekf_ablation" else ["duration_s"]
    wanted = {tuple(r) for r in event_intervals(spark, data).groupBy(*keys).agg(F.count(F.lit(1))).collect()}
    assert {r["duration_s"] for r in event_intervals(spark, data).collect()} == set(B.DURATIONS)
    found = filters.QUERIES[name](spark, data)
    if name == "ekf_ablation":
        for variant in ("all", "no_speed", "no_track", "no_turn"):
            assert {(r["duration_s"], r["intervals"]) for r in found.where(F.col("variant") == variant).collect()} == wanted
    else:
        assert {(r["session_id"], r["duration_s"], r["intervals"]) for r in found.collect()} == wanted


def sessions(frame, names, key=("session_id", "duration_s")):
    found = {}
    for r in frame.select(*names).collect():
        found.setdefault(tuple(r[k] for k in key), []).append(r.asDict())
    return {k: sorted(v, key=lambda r: r["i"]) for k, v in found.items()}


@pytest.mark.parametrize("use", [FB.Settings(), FB.Settings(speed=False), FB.Settings(track=False), FB.Settings(turn=False)])
def test_version_a_is_the_scalar_filter(spark, data, use):
    """Every step of all sessions and schedules of version A and its ablations, against a second form of the filter."""
    steps = filters._steps(spark, data)[0]
    rows = sessions(steps, ["session_id", "duration_s", "i", "t_s", "imu", "speed_ms", "rel_q", "gt_lat", "gt_lon", "gt_heading_deg", "is_blackout", "interval_idx"])
    assert any(r["rel_q"] is not None for v in rows.values() for r in v)
    found = sessions(FB.run_filter(steps, use), ["session_id", "duration_s", "i", "e", "n", "heading_deg"])
    assert found.keys() == rows.keys()
    for key in sorted(rows):
        for got, (e, n, heading, _) in zip(found[key], scalar_filter.run(rows[key], use), strict=True):
            assert abs(got["e"] - e) < 1e-5 and abs(got["n"] - n) < 1e-5 and abs((got["heading_deg"] - heading + 180) % 360 - 180) < 1e-6


def test_version_b_is_the_scalar_filter(spark, data):
    """The same with roads: places and match outcomes."""
    steps, roads, _ = filters._road_inputs(spark, data)
    rows = sessions(steps, ["session_id", "duration_s", "i", "t_s", "imu", "speed_ms", "rel_q", "gt_lat", "gt_lon", "gt_heading_deg", "is_blackout", "interval_idx"])
    held = {}
    for r in roads.orderBy("segment_idx").collect():
        held.setdefault((r["session_id"], r["duration_s"]), {}).setdefault(r["interval_idx"], []).append((r["ax"], r["ay"], r["bx"], r["by"]))
    found = sessions(FB.run_filter_on_roads(steps, roads), ["session_id", "duration_s", "i", "e", "n", "road_outcome"])
    matched = 0
    for key in sorted(rows):
        for got, (e, n, _, outcome) in zip(found[key], scalar_filter.run(rows[key], FB.Settings(), held.get(key, {})), strict=True):
            assert abs(got["e"] - e) < 1e-5 and abs(got["n"] - n) < 1e-5 and got["road_outcome"] == outcome
            matched += outcome == "matched"
    assert matched > 10


def test_measured_turns(spark):
    rows = spark.createDataFrame([(10.0, 350.0), (350.0, 10.0), (90.0, None), (270.0, 90.0)], "now double, start double")
    turns = [r[0] for r in rows.select(FB.measured_turn(F.col("now"), F.col("start"), F.lit(0.0))).collect()]
    assert turns[2] is None and all(q[0] >= 0 for q in turns if q)
    for q, now, start in zip(turns, (10, 350, None, 270), (350, 10, None, 90), strict=True):
        if q:
            assert abs((heading_of(product(heading_quat(start), np.array(q))) - now + 180) % 360 - 180) < 1e-9
