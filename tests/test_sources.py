import json

import pytest
from pyspark.sql import functions as F

from wayline.operators import stats
from wayline.operators.infer import infer
from wayline.plans import reports
from wayline.plans.onnx_models import linear_over_window
from wayline.sources import live, lookups, recordings as RC

PHONE = "GPS LATITUDE (degrees),TIME SINCE START (ms),DATE (YYYY-MO-DD),ACCELEROMETER X (m/s),ACCELEROMETER Y (m/s),ACCELEROMETER Z (m/s),GYROSCOPE {} (rad/s),GYROSCOPE {} (rad/s),GYROSCOPE {} (rad/s),ORIENTATION ({}) (deg),ORIENTATION (Pitch) (deg),ORIENTATION (Roll ) (deg)"
DIALECTS = [PHONE.format("Yaw", "Pitch", "Roll", "Yaw"), PHONE.format("X", "Y", "Z", "Azimuth")]
VEHICLE = "Vertical velocity (km/hr),Time Since Start of Day (seconds),Latitude (degrees),Longitude (degrees),Velocity (km/hr),Heading (degrees)"


def test_headers():
    for header in DIALECTS:
        found = RC.phone_header(header.split(","))
        assert (found["accel_x"], found["gyro_z"], found["orient_yaw"], found["time_ms"]) == (3, 8, 9, 1)
    assert RC.vehicle_header(VEHICLE.split(","))["velocity_kmh"] == 4
    with pytest.raises(ValueError):
        RC.phone_header(["ACCELEROMETER X"])
    with pytest.raises(ValueError):
        RC.vehicle_header(["Vertical velocity (km/hr)"])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    line = lambda i, time=None: f"51.0,{100 * i if time is None else time},2020-01-01,{i},0,9.8,0.1,0.2,0.3,{i},0,0"
    rows = [line(i) for i in range(120)]
    rows[5] = rows[5].replace("51.0", "nan")
    rows[7] += ",extra"
    rows[9] = rows[9].replace("51.0", "unknown")
    (tmp_path / "a" / "S-M1.csv").write_text("\n".join([DIALECTS[0], *rows]) + "\n")
    (tmp_path / "a" / "S-M2.csv").write_text("\n".join([DIALECTS[0], *rows[:3]]) + "\n")
    (tmp_path / "b" / "V-M1.csv").write_text("\n".join([VEHICLE, *(f"0,{i},51.{i},0.{i},36,90" for i in range(120))]) + "\n")
    return tmp_path


def test_scan_pair_and_window(spark, folder):
    phones, vehicles = RC.list_files(spark, str(folder), "S-*.csv"), RC.list_files(spark, str(folder), "V-*.csv")
    pairs, alone = RC.matched_pairs(phones, vehicles)
    assert [r["session_id"] for r in pairs.collect()] == ["S-M1"] and [r["session_id"] for r in alone.collect()] == ["S-M2"]
    phone = RC.scan(spark, str(folder / "a" / "S-M1.csv"), RC.phone_header)
    assert RC.malformed_by_file(phone).first()["malformed"] == 2
    assert phone.where("not malformed").count() == 118
    vehicle = RC.scan(spark, str(folder / "b" / "V-M1.csv"), RC.vehicle_header)
    windows = RC.windowed(phone, vehicle).orderBy("window_idx").collect()
    assert [r["window_idx"] for r in windows] == list(range(7))
    assert windows[0]["velocity_ms"] == 10.0 and len(windows[0]["imu"]) == 50 and windows[0]["imu"][5][0] == 6.0  # row 5 was malformed
    assert windows[0]["start_ms"] == 0 and windows[0]["end_ms"] == 5100
    truth = RC.ground_truth(vehicle.where("not malformed"), spark.createDataFrame([("S-M1", 0), ("S-M1", 99)], "session_id string, window_idx long"))
    assert [r["lat"] for r in truth.orderBy("window_idx").collect()] == [51.49, 51.119]
    RC.write_windows(RC.windowed(phone, vehicle), str(folder / "out"))
    assert spark.read.parquet(str(folder / "out" / "windows")).count() == 7
    stats_row = spark.read.parquet(str(folder / "out" / "dataset_stats")).first()
    assert abs(stats_row["normalize_mean"][2] - 9.8) < 1e-5 and stats_row["normalize_std"][1] == 1.0 and json.loads(stats_row["metadata_json"])["windows"] == 7


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    """Two dialects with their columns in another order, CRLF line ends, a header alone, split files."""
    one = "TIME SINCE START (ms),ACCELEROMETER X (m/s),ACCELEROMETER Y (m/s),ACCELEROMETER Z (m/s),GYROSCOPE Yaw (rad/s),GYROSCOPE Pitch (rad/s),GYROSCOPE Roll (rad/s)"
    two = "ACCELEROMETER X (m/s),TIME SINCE START (ms),ACCELEROMETER Y (m/s),ACCELEROMETER Z (m/s),GYROSCOPE X (rad/s),GYROSCOPE Y (rad/s),GYROSCOPE Z (rad/s),GRAVITY X (m/s)"
    (tmp_path / "S-1.csv").write_text("\n".join([one, *(f"{100 * i},{i},2,3,4,5,6" for i in range(2000))]) + "\n")
    (tmp_path / "S-2.csv").write_text("\r\n".join([two, "1,100,2,3,4,5,6,7", "", "2,200,2,3,4,5,6", "x,300,2,3,4,5,6,7"]))
    (tmp_path / "S-3.csv").write_text(one + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = RC.scan(spark, str(tmp_path), RC.phone_header).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {(r["session_id"], r["seq"]): r for r in rows if not r["malformed"]}
    assert len(rows) == 2003 and all(by["S-1", i]["time_ms"] == 100 * i and by["S-1", i]["accel_x"] == i and by["S-1", i]["gravity_x"] is None for i in range(2000))
    assert (by["S-2", 0]["time_ms"], by["S-2", 0]["accel_x"], by["S-2", 0]["gravity_x"]) == (100.0, 1.0, 7.0)
    assert by["S-2", 1]["time_ms"] == 300.0 and by["S-2", 1]["accel_x"] != by["S-2", 1]["accel_x"]  # no number: NaN
    assert sum(r["malformed"] for r in rows) == 1
    (tmp_path / "S-4.csv").write_text("ACCELEROMETER X\n1\n")
    with pytest.raises(ValueError):
        RC.scan(spark, str(tmp_path), RC.phone_header)


def test_a_file_of_several_splits(spark, tmp_path):
    """Numbers go on from split to split; a split with no good row and malformed rows at the edges count nothing."""
    line = lambda i: f"{'nan' if i % 7 == 3 or 300 <= i < 420 else 51.0},{100 * i},2020-01-01,{i},0,9.8,0.1,0.2,0.3,{i},0,0"
    for name, n in (("S-LONG.csv", 1000), ("S-SHORT.csv", 5)):
        (tmp_path / name).write_text("\n".join([DIALECTS[0], *(line(i) for i in range(n))]) + "\n")
    options = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path / "S-LONG.csv")).rdd.getNumPartitions() > 20
        rows = RC.scan(spark, str(tmp_path), RC.phone_header).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for session, n in (("S-LONG", 1000), ("S-SHORT", 5)):
        good = sorted((r["seq"], r["accel_x"]) for r in rows if r["session_id"] == session and not r["malformed"])
        kept = [i for i in range(n) if not (i % 7 == 3 or 300 <= i < 420)]
        assert good == [(k, float(i)) for k, i in enumerate(kept)]
    assert len(rows) == 1005 and all(r["seq"] is None for r in rows if r["malformed"])


def test_lookups(spark):
    body = json.dumps([{"lat": "28.5", "lon": "77.25", "display_name": "there"}])
    rows = spark.createDataFrame([("a", body), ("b", "[]"), ("c", "no json")], "query string, body string")
    found = {r["query"]: (r["lat"], r["place"]) for r in lookups.places(rows).collect()}
    assert found == {"a": (28.5, "there"), "b": (None, None), "c": (None, None)}
    route = json.dumps({"code": "Ok", "routes": [{"distance": 1200.5, "duration": 90, "geometry": {"coordinates": [[77.1, 28.1], [77.2, 28.2]]}}]})
    answers = spark.createDataFrame([("r", route), ("x", '{"code":"NoRoute"}')], "route_id string, body string")
    assert {r["route_id"]: r["distance_m"] for r in lookups.routes(answers).collect()} == {"r": 1200.5, "x": None}
    assert [(r["seq"], r["lat"], r["lon"]) for r in lookups.route_points(answers).orderBy("seq").collect()] == [(0, 28.1, 77.1), (1, 28.2, 77.2)]


def test_splits():
    ids = [f"s{i}" for i in range(144)]
    found = stats.split_of(ids)
    assert [len(found[p]) for p in ("train", "val", "test")] == [116, 14, 14]
    assert set(found["train"]) | set(found["val"]) | set(found["test"]) == set(ids)
    assert found == stats.split_of(ids[::-1])
    assert [len(x) for x in stats.split_of(["a", "b"]).values()] == [1, 1, 0]
    assert [len(x) for x in stats.split_of(["a"]).values()] == [1, 0, 0]
    assert [len(x) for x in stats.split_of(["a", "b", "c"]).values()] == [1, 1, 1]


def test_scores_and_stats(spark):
    df = spark.createDataFrame([(5.0, 10.0), (10.0, 10.5)], "p double, t double")
    row = stats.speed_scores(df, "p", "t").first()
    assert row["mae_ms"] == 2.75 and abs(row["mae_kmh"] - 9.9) < 1e-9 and row["smooth_l1"] == (4.5 + 0.125) / 2
    same = spark.createDataFrame([(2.0,), (2.0,)], "c double")
    assert stats.channel_stats(same, ["c"]).first()["std"] == 1.0


def test_inference(spark):
    model = linear_over_window([1.0] * 6, 50)
    rows = spark.createDataFrame([(1, [[1.0] * 6] * 50), (2, [[2.0] * 6] * 50)], "id int, imu array<array<double>>")
    found = {r["id"]: r["y"] for r in infer(rows, model, "imu", "y", mean=[1.0] * 6, std=[2.0] * 6, out_mean=10.0, out_std=3.0).collect()}
    assert abs(found[1] - 10) < 1e-5 and abs(found[2] - 19) < 1e-5
    with pytest.raises(Exception, match="shape"):
        infer(rows.withColumn("imu", F.slice("imu", 1, 49)), model, "imu", "y").collect()
    assert infer(rows.where("id > 5"), model, "imu", "y").count() == 0


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 1.23456), ("a", 10, 2.0), ("b", 5, 3.0)], "session_id string, duration_s int, final_error_m double")
    report = reports.json_report(rows, ["session_id", "duration_s"], ["final_error_m"])
    assert json.loads(report.first()["report"]) == {"a": {"5": {"final_error_m": 1.235}, "10": {"final_error_m": 2.0}}, "b": {"5": {"final_error_m": 3.0}}}
    reports.write_json(report, str(tmp_path / "j"))
    assert reports.read_report(spark, str(tmp_path / "j")).count() == 1
    assert reports.read_report(spark, str(tmp_path / "missing")) is None
    reports.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_live_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"device":"d","ts_ns":5000000000,"lat":1.0,"lon":2.0,"alt":3.0}\n')
    fixes = live.with_time(live.stream(spark, "gnss_fixes", str(tmp_path / "in")))
    query = fixes.writeStream.format("memory").queryName("fixes").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("fixes")
    assert rows.first()["ts"].second == 5 and live.last_known(rows).first()["lat"] == 1.0


def test_truth_gathers_no_samples(spark, data, monkeypatch):
    """The places at the windows' ends need neither the windows' samples nor a data set of them written."""
    from wayline.plans import recording_path

    ends = {(r["session_id"], r["window_idx"]) for r in recording_path.recording_windows(spark, data).select("session_id", "window_idx").collect()}
    monkeypatch.setattr(RC, "write_windows", None)
    found = recording_path.recording_truth(spark, data)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["session_id"], r["window_idx"]) for r in found.collect()} == ends
