"""Closed-form outage scenarios."""

import math

import pytest
from pyspark.sql import functions as F

from wayline.operators import blackout as B
from wayline.operators.deadreckon import blended, circular_blended
from wayline.operators.tracking import evaluate, track
from wayline.sources.synthetic import straight_drive

INTERVALS = "session_id string, duration_s int, interval_idx int, start_s double, end_s double"


def drive(spark, seconds, bias=0.0, speed=10.0):
    steps = spark.range(seconds + 1).select(F.lit("s").alias("session_id"), F.col("id").alias("i"), F.col("id").cast("double").alias("t_s"))
    lat = F.lit(51.4778) + F.degrees(F.col("t_s") * speed / 6371000.0)
    return steps.withColumns(
        {"speed_ms": F.lit(speed + bias), "gyro_z": F.lit(0.0), "gt_lat": lat, "gt_lon": F.lit(-0.0014), "gt_heading_deg": F.lit(0.0), "dt": F.when(F.col("i") == 0, 0.0).otherwise(1.0)}
    )


def outages(spark, *pairs):
    return spark.createDataFrame([("s", int(e - s), n, float(s), float(e)) for n, (s, e) in enumerate(pairs)], INTERVALS).withColumn("duration_s", F.lit(1))


def test_no_bias_no_error(spark):
    row = evaluate(drive(spark, 60), outages(spark, (10, 40))).first()
    assert row["max_error_m"] < 1e-6 and abs(row["traveled_distance_m"] - 300) < 1e-9 and row["points_count"] == 31


@pytest.mark.parametrize("bias, pairs, errors", [(1.0, [(10, 20)], [11]), (2.0, [(10, 30)], [42]), (1.0, [(10, 20), (50, 70)], [11, 21])])
def test_bias_grows(spark, bias, pairs, errors):
    rows = evaluate(drive(spark, 80, bias), outages(spark, *pairs)).orderBy("start_s").collect()
    assert [round(r["final_error_m"], 3) for r in rows] == errors  # both ends belong to the interval
    for r, (s, e) in zip(rows, pairs, strict=True):
        assert abs(r["traveled_distance_m"] - (10 + bias) * (e - s)) < 1e-6
        assert abs(r["relative_drift_percent"] - r["final_error_m"] / r["traveled_distance_m"] * 100) < 1e-9


def test_snaps_back_after_the_outage(spark):
    rows = {r["t_s"]: r["error_m"] for r in track(drive(spark, 60, 2.0), outages(spark, (10, 30))).collect()}
    assert rows[30.0] > 35 and rows[31.0] < 1e-6


@pytest.mark.parametrize("heading, north, east", [(0.0, 100, 0), (90.0, 0, 100)])
def test_straight_drive(spark, heading, north, east):
    rows = straight_drive(spark, 10.1, 10, 10.0, heading_deg=heading).orderBy("i").collect()
    first, last = rows[0], rows[-1]
    assert abs(math.radians(last["gt_lat"] - first["gt_lat"]) * 6371000 - north) < 1.1
    assert abs(math.radians(last["gt_lon"] - first["gt_lon"]) * 6371000 * math.cos(math.radians(51.4778)) - east) < 1.1


def test_schedule(spark):
    lengths = spark.createDataFrame([("a", 100.0), ("b", 15.0)], "session_id string, total_s double")
    rows = B.outage_intervals(lengths, (5, 30)).collect()
    starts = lambda s, d: [r["start_s"] for r in sorted(rows, key=lambda r: r["interval_idx"]) if (r["session_id"], r["duration_s"]) == (s, d)]
    assert starts("a", 5) == [20, 40, 60, 80] and starts("a", 30) == [20, 40, 60]
    assert starts("b", 5) == [5.0] and starts("b", 30) == [1.0]


def test_membership_is_closed_and_never_the_first_step(spark):
    rows = B.in_outage(drive(spark, 5), outages(spark, (0, 3))).orderBy("i").collect()
    assert [r["is_blackout"] for r in rows] == [False, True, True, True, False, False]


def test_bad_interval_fails(spark):
    with pytest.raises(Exception, match="ends before"):
        B.checked_intervals(outages(spark, (5, 3))).collect()


def test_blends():
    assert abs(math.degrees(blended(math.radians(359), 0, 1, math.radians(1))) - 323.2) < 1e-9
    assert abs(math.degrees(circular_blended(math.radians(359), 0, 1, math.radians(1))) - 359.2) < 1e-9
    assert abs(math.degrees(blended(math.radians(350), math.radians(20), 1, None)) - 10) < 1e-9
