import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import roads as R

KEYS = ["road_id"]


def road(spark, *vertices):
    rows = [("r", n, float(e), float(m)) for n, (e, m) in enumerate(vertices)]
    return R.segments(spark.createDataFrame(rows, "road_id string, vertex int, e double, n double"), KEYS)


def match(spark, vertices, points, gates=R.Gates(), road_id="r"):
    rows = spark.createDataFrame([(road_id, i, float(e), float(n), float(h)) for i, (e, n, h) in enumerate(points)], "road_id string, i int, e double, n double, heading_deg double")
    return R.match(rows, road(spark, *vertices), KEYS, gates).orderBy("i").collect()


STRAIGHT = [(0, 0), (100, 0)]


def test_two_way_and_heading_gate(spark):
    rows = match(spark, STRAIGHT, [(50, 5, 90), (50, 5, 270), (50, 5, 0), (50, 5, 121), (50, 5, 120)])
    assert [r["outcome"] for r in rows] == ["matched", "matched", "heading", "heading", "matched"]
    assert rows[0]["distance_m"] == 5 and rows[2]["corr_n"] == 5 and rows[2]["segment_idx"] == -1
    assert "heading diff 90.0deg exceeds" in rows[2]["rejection_reason"] and rows[0]["rejection_reason"] == ""


def test_nearest_segment_and_ties(spark):
    rows = match(spark, [(0, 0), (50, 0), (50, 50)], [(25, 5, 90), (55, 25, 0), (55, -5, 45)], R.Gates(max_heading_deg=90.0))
    assert [r["segment_idx"] for r in rows] == [0, 1, 0]


def test_distance_gate_is_inclusive(spark):
    rows = match(spark, STRAIGHT, [(50, 5, 90), (50, 5.001, 90)], R.Gates(max_distance_m=5.0))
    assert [r["outcome"] for r in rows] == ["matched", "distance"] and math.isinf(rows[1]["distance_m"])
    assert rows[1]["rejection_reason"].startswith("distance 5.0m exceeds max_match_dist_m (5.0m)")


@pytest.mark.parametrize("strength, n", [(0.0, 10), (0.5, 5), (1.0, 0)])
def test_strength(spark, strength, n):
    assert match(spark, STRAIGHT, [(50, 10, 90)], R.Gates(strength=strength))[0]["corr_n"] == n


def test_no_road(spark):
    row = match(spark, STRAIGHT, [(50, 10, 90)], road_id="other")[0]
    assert not row["matched"] and row["segment_idx"] == -1 and math.isinf(row["distance_m"]) and row["rejection_reason"] == "no road polyline provided"
    assert (row["corr_e"], row["corr_n"]) == (50, 10)


def test_ends_and_degenerate_segment(spark):
    rows = match(spark, [(0, 0), (0, 0), (10, 0)], [(-3, 4, 90), (14, 3, 90)], R.Gates(max_heading_deg=90.0))
    assert [r["distance_m"] for r in rows] == [5, 5] and rows[1]["proj_e"] == 10


@pytest.mark.parametrize("bad", [{"strength": 1.5}, {"max_distance_m": 0}, {"max_heading_deg": 91}])
def test_gates_are_checked(bad):
    with pytest.raises(ValueError):
        R.Gates(**bad)


def test_stats_and_rollup(spark):
    rows = spark.createDataFrame([("r", i, 50.0, n, h) for i, (n, h) in enumerate([(4.0, 90.0), (8.0, 90.0), (99.0, 90.0), (5.0, 0.0)])], "road_id string, i int, e double, n double, heading_deg double")
    found = R.match_stats(R.match(rows, road(spark, *STRAIGHT), KEYS), KEYS).first()
    assert (found["n_steps"], found["n_matched"], found["n_rejected_distance"], found["n_rejected_heading"]) == (4, 2, 1, 1)
    assert found["match_fraction"] == 0.5 and found["avg_correction_m"] == 3 and found["max_correction_m"] == 4


def test_roads_use_only_the_past(spark):
    lat = F.lit(51.4778) + F.degrees(F.col("t_s") * 10 / 6371000.0)
    fixes = spark.range(30).select(F.lit("s").alias("session_id"), F.col("id").alias("i"), F.col("id").cast("double").alias("t_s")).withColumns({"gt_lat": lat, "gt_lon": F.lit(0.0), "ref_lat": F.lit(51.4778), "ref_lon": F.lit(0.0)})
    outages = spark.createDataFrame([("s", 5, 0, 10.0, 15.0), ("s", 5, 1, 0.0, 5.0), ("s", 5, 2, 20.0, 25.0)], "session_id string, duration_s int, interval_idx int, start_s double, end_s double")
    found = R.past_roads(fixes, outages)
    tops = {r["interval_idx"]: round(r["n"]) for r in found.groupBy("interval_idx").agg(F.max("n").alias("n")).collect()}
    assert tops == {0: 90, 2: 190}
    clean = {r["interval_idx"]: r["count"] for r in R.past_roads(fixes, outages, exclude_outages=True).groupBy("interval_idx").count().collect()}
    assert clean == {0: 4, 2: 8}
    still = fixes.withColumn("gt_lat", F.lit(51.4778))
    assert R.past_roads(still, outages).count() == 0


def test_route_progress(spark):
    points = spark.createDataFrame([("r", i, a, b) for i, (a, b) in enumerate([(28.5451, 77.2721), (28.5480, 77.2750), (28.5520, 77.2800)])] + [("one", 0, 1.0, 1.0)], "route_id string, seq int, lat double, lon double")
    at = spark.createDataFrame([("r", 28.5451, 77.2721), ("r", 28.5520, 77.2800), ("one", 1.0, 1.0), ("none", 1.0, 1.0)], "route_id string, lat double, lon double")
    rows = {(r["route_id"], r["lat"]): r for r in R.route_progress(at, points).collect()}
    assert rows["r", 28.5451]["percent"] == 0 and rows["r", 28.5520]["percent"] == 100
    assert rows["one", 1.0]["progress_text"] == "Progress: 100%" and rows["none", 1.0]["progress_text"] == "Progress: --"


def test_nearest_points_match_brute_force(spark):
    """Near and far positions, ties, equal places, the poles and the date line."""
    rng = random.Random(5)
    points = [("r", i, 51 + rng.random() * 0.01, rng.random() * 0.01) for i in range(150)] + [("r", 150 + i, 51.005, 0.005) for i in range(3)]
    points += [("w", i, a, b) for i, (a, b) in enumerate([(0.0, 179.9999), (0.0, -179.9999), (89.9999, 10.0), (-89.9, 0.0), (0.0, 1.0), (0.0, -1.0)])] + [("w", 9, None, 1.0)]
    at = [("r", 51 + rng.random() * 0.02, rng.random() * 0.02) for _ in range(80)] + [("r", 40.0, 100.0), ("r", 51.005, 0.005), ("r", None, 1.0), ("none", 1.0, 1.0)]
    at += [("w", 0.0, 180.0), ("w", 89.9999, -170.0), ("w", 0.0, 0.0), ("w", -60.0, 45.0)]
    p = spark.createDataFrame([(*x, float(x[1])) for x in points], "k string, seq int, lat double, lon double, to_end_m double")
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(at)], "n int, k string, lat double, lon double")

    def away(x, y):
        h = math.sin(math.radians(y[0] - x[0]) / 2) ** 2 + math.cos(math.radians(x[0])) * math.cos(math.radians(y[0])) * math.sin(math.radians(y[1] - x[1]) / 2) ** 2
        return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h)))

    found = {r["n"]: r for r in R.nearest_points(a, p, ["k"], "n").collect()}
    for i, (k, lat, lon) in enumerate(at):
        near = sorted((round(away((lat, lon), (x[2], x[3])), 6), x[1]) for x in points if x[0] == k and None not in (lat, x[2]))
        if not near:
            assert i not in found
        else:
            assert found[i]["d"] == pytest.approx(near[0][0], abs=1e-5) and found[i]["seq"] in [s for d, s in near if d <= near[0][0] + 1e-5] and found[i]["rest"] == found[i]["seq"]
    assert found[81]["seq"] == 150


def test_a_long_route(spark):
    """One route of 100,000 points with as many positions: work grows with the points, not with their square."""
    rows = spark.range(100_000).select(F.lit("r").alias("route_id"), F.col("id").alias("seq"), (51 + F.col("id") * 1e-5).alias("lat"), (F.sin(F.col("id") / 50) / 1000).alias("lon"))
    began = time.perf_counter()
    found = R.route_progress(rows.withColumn("lon", F.col("lon") + 1e-5).drop("seq"), rows)
    least, most, n = found.agg(F.min("remaining_m"), F.max("remaining_m"), F.count("remaining_m")).first()
    assert n == 100_000 and least < 2 and most > 111_000 and time.perf_counter() - began < 60


@pytest.mark.parametrize("leaf, fan", [(1, 2), (3, 2), (16, 16)])
def test_index_nodes_are_bounded_and_whole(spark, leaf, fan):
    rng = random.Random(9)
    rows = [(k, i, 51 + rng.random() * s, rng.random() * s, 0.0) for k, s, n in (("a", 1e-6, 90), ("b", 1.0, 7), ("c", 1e-3, 200)) for i in range(n)]
    points = spark.createDataFrame(rows, "k string, seq int, lat double, lon double, to_end_m double").withColumn("_p", F.struct("seq", "to_end_m"))
    levels = R._point_index(points, ["k"], leaf, fan)
    assert all(r["n"] <= (leaf if i == 0 else fan) for i, level in enumerate(levels) for r in level.select(F.size("kids").alias("n")).collect())
    assert levels[0].select(F.sum(F.size("kids"))).first()[0] == len(rows) and levels[-1].count() == 3
    at = spark.createDataFrame([(i, k, 51 + rng.random() * s, rng.random() * s) for i, (k, s) in enumerate([("a", 2e-6), ("b", 2.0), ("c", 1e-3)] * 30)], "n int, k string, lat double, lon double")
    found = {r["n"]: r["d"] for r in R.nearest_points(at, points.drop("_p"), ["k"], "n", leaf, fan).collect()}
    away = geo.haversine_atan2_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    every = at.join(points.select("k", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "k").groupBy("n").agg(F.min(away).alias("d"))
    assert found == {r["n"]: pytest.approx(r["d"], abs=1e-6) for r in every.collect()} and len(found) == 90


def test_a_standing_vehicle(spark):
    """100,000 points and as many positions within 10 m: no position meets more than a few leaves."""
    n = 100_000
    place = lambda c, seed: (c + F.rand(seed) * 8e-5)
    points = spark.range(n).select(F.lit("r").alias("k"), F.col("id").alias("seq"), place(F.lit(51.0), 1).alias("lat"), place(F.lit(0.0), 2).alias("lon"), F.lit(0.0).alias("to_end_m")).checkpoint()
    at = spark.range(n).select(F.col("id").alias("n"), F.lit("r").alias("k"), place(F.lit(51.0), 3).alias("lat"), place(F.lit(0.0), 4).alias("lon")).checkpoint()
    began = time.perf_counter()
    found = R.nearest_points(at, points, ["k"], "n").toPandas()
    assert time.perf_counter() - began < 120 and sorted(found["n"]) == list(range(n))
    p, a = points.toPandas(), at.where("n % 1000 = 0").toPandas()
    lat, lon = np.radians(p["lat"].to_numpy()), np.radians(p["lon"].to_numpy())
    near = found.set_index("n")["d"]
    for i, x, y in zip(a["n"], np.radians(a["lat"]), np.radians(a["lon"]), strict=True):
        h = np.sin((lat - x) / 2) ** 2 + np.cos(x) * np.cos(lat) * np.sin((lon - y) / 2) ** 2
        assert abs(near[i] - 2 * 6371000.0 * np.arcsin(np.sqrt(h)).min()) < 1e-6


def drive(spark, n):
    """A session that stands still for stretches, so that look-backs begin at fixes that aren't kept."""
    i = F.col("id")
    moving = i - F.greatest(i % 40 - 25, F.lit(0))
    return spark.range(n).select(
        F.lit("s").alias("session_id"), i.cast("double").alias("t_s"), (51.4778 + moving * 2e-6).alias("gt_lat"), (F.sin(moving / 50) / 1e3).alias("gt_lon"), F.lit(51.4778).alias("ref_lat"), F.lit(0.0).alias("ref_lon"),
    )


@pytest.mark.parametrize("lookback", [0.0, 7.0, 33.0, 120.0])
def test_ranges_are_the_roads(spark, lookback):
    fixes = drive(spark, 400).where("t_s >= 3")
    starts = [0.0, 3.0, 4.0, 6.0, 31.0, 38.0, 41.0, 66.5, 70.0, 82.0, 84.0, 199.0, 395.0, 900.0]
    outages = spark.createDataFrame([("s", 5.0, k, t, t + 5) for k, t in enumerate(starts)] + [("none", 5.0, 0, 9.0, 14.0)], "session_id string, duration_s double, interval_idx int, start_s double, end_s double")
    whole = {tuple(r)[:4]: (r["e"], r["n"]) for r in R.past_roads(fixes, outages, lookback).collect()}
    polyline, ranges = R.road_ranges(fixes, outages, lookback)
    parts = {tuple(r)[:4]: (r["e"], r["n"]) for r in R.range_vertices(polyline, ranges).collect()}
    assert parts == whole and len(whole) > 10
    for r in ranges.collect():
        road = [whole[r["session_id"], r["duration_s"], r["interval_idx"], v] for v in range(r["n_vertices"])]
        assert abs(sum(math.dist(p, q) for p, q in zip(road, road[1:])) - r["length_m"]) < 1e-6
    if lookback in (7.0, 33.0):
        assert ranges.where("start is not null").count() > 0


def test_ranges_of_a_long_session(spark):
    """100,000 fixes, all of which lie before most of 2,000 outages: no copy of them a outage."""
    outages = spark.range(2000).select(
        F.lit("s").alias("session_id"), F.lit(5.0).alias("duration_s"), F.col("id").cast("int").alias("interval_idx"), (F.col("id") * 50.0 + 60).alias("start_s"), (F.col("id") * 50.0 + 65).alias("end_s")
    )
    began = time.perf_counter()
    polyline, ranges = R.road_ranges(drive(spark, 100_000), outages, 0.0)
    found = ranges.agg(F.count(F.lit(1)).alias("n"), F.max("last_vertex").alias("v"), F.min("first_vertex").alias("f")).first()
    assert time.perf_counter() - began < 30
    assert found["n"] == 2000 and found["f"] == 0 and found["v"] == polyline.where("t_s < 100010").count() - 1


def test_the_nearest_segment_is_worked_out_once(spark):
    """However often the result mentions it, also in a filter after it; the first on a tie, none on an empty road."""
    points = spark.createDataFrame([("a", 1.0, 5.0, 0.0), ("a", 0.0, 20.0, 0.0), ("b", 0.0, 0.0, 0.0)], "k string, e double, n double, heading_deg double")
    roads = spark.createDataFrame([("a", i, 0.0, i * 10.0, 0.0, i * 10.0 + 10) for i in range(3)], "k string, segment_idx int, ax double, ay double, bx double, by double")
    found = R.match(points, roads, ["k"]).where("matched")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("lambda") < 20
    assert sorted((r["n"], r["segment_idx"], r["distance_m"]) for r in found.collect()) == [(5.0, 0, 1.0), (20.0, 1, 0.0)]


def test_short_routes_need_no_index(spark, monkeypatch):
    """Routes of one leaf are compared with as they are, whatever the number of routes; many positions are dealt to parts."""
    monkeypatch.setattr(R, "_point_index", None)
    monkeypatch.setattr(R, "ASKED", 100)
    points = spark.range(600).select((F.col("id") % 20).alias("k"), F.col("id").alias("seq"), (51 + F.col("id") * 1e-4).alias("lat"), F.lit(0.0).alias("lon"), F.lit(1.0).alias("to_end_m"))
    at = points.where("k < 19").select("k", F.col("seq").alias("n"), (F.col("lat") + 1e-6).alias("lat"), "lon")
    at = at.unionByName(spark.range(1000, 2000).select(F.lit(3).cast("long").alias("k"), F.col("id").alias("n"), F.lit(51.0003).alias("lat"), F.lit(0.0).alias("lon")))
    found = R.nearest_points(at, points, ["k"], "n").toPandas()
    assert dict(zip(found["n"], found["seq"], strict=True)) == {n: n for n in range(600) if n % 20 < 19} | dict.fromkeys(range(1000, 2000), 3)
