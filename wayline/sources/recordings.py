"""Paired phone and vehicle recordings: tolerant CSV scans, header dialects, file pairing, the windowed data set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import quat
from wayline.functions.geo import kmh_to_ms
from wayline.operators import sequence as S
from wayline.operators.stats import window_channel_stats
from wayline.schemas import IMU

HeaderRule = Callable[[list[str]], dict[str, int]]

#: How header texts, in capitals, name a phone's channels: by a part, by the beginning, or whole. The first rule that a
#: text meets counts; a later column of the same channel replaces an earlier one. Fixed values.
PHONE_RULES = (
    ("time_ms", "part", "TIME SINCE START"), ("date_str", "begins", "DATE"),
    ("accel_x", "part", "ACCELEROMETER X"), ("accel_y", "part", "ACCELEROMETER Y"), ("accel_z", "part", "ACCELEROMETER Z"),
    ("gyro_x", "part", "GYROSCOPE YAW"), ("gyro_x", "whole", "GYROSCOPE X (RAD/S)"),
    ("gyro_y", "part", "GYROSCOPE PITCH"), ("gyro_y", "whole", "GYROSCOPE Y (RAD/S)"),
    ("gyro_z", "part", "GYROSCOPE ROLL"), ("gyro_z", "whole", "GYROSCOPE Z (RAD/S)"),
    ("gravity_x", "part", "GRAVITY X"), ("gravity_y", "part", "GRAVITY Y"), ("gravity_z", "part", "GRAVITY Z"),
    ("mag_x", "part", "MAGNETIC FIELD X"), ("mag_y", "part", "MAGNETIC FIELD Y"), ("mag_z", "part", "MAGNETIC FIELD Z"),
    ("orient_yaw", "part", "ORIENTATION (YAW)"), ("orient_yaw", "part", "ORIENTATION (AZIMUTH)"),
    ("orient_pitch", "part", "ORIENTATION (PITCH)"), ("orient_roll", "part", "ORIENTATION (ROLL"),
)
#: The same for a vehicle's; its speed must not be taken from "Vertical velocity (km/hr)". Fixed values.
VEHICLE_RULES = (
    ("time_s", "part", "TIME SINCE START OF DAY"), ("time_s", "whole", "TIME (SECONDS)"),
    ("velocity_kmh", "whole", "VELOCITY (KM/HR)"), ("velocity_kmh", "whole", "VELOCITY"),
    ("heading_deg", "part", "HEADING"), ("indicated_speed_kmh", "part", "INDICATED VEHICLE SPEED"),
    ("lat", "part", "LATITUDE"), ("lon", "part", "LONGITUDE"),
)
_MEETS = {"part": lambda text, name: name in text, "begins": str.startswith, "whole": str.__eq__}


def resolved(header: list[str], rules: tuple, needed: tuple[str, ...]) -> dict[str, int]:
    found: dict[str, int] = {}
    for at, text in enumerate(h.strip().upper() for h in header):
        channel = next((c for c, how, name in rules if _MEETS[how](text, name)), None)
        if channel:
            found[channel] = at
    if missing := [c for c in needed if c not in found]:
        raise ValueError(f"the header {header} lacks {missing}")
    return found


def phone_header(header: list[str]) -> dict[str, int]:
    return resolved(header, PHONE_RULES, IMU)


def vehicle_header(header: list[str]) -> dict[str, int]:
    return resolved(header, VEHICLE_RULES, ("velocity_kmh",))


def valid_numbers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as doubles and `malformed`: whether any of them spells NaN or an infinity. Other texts that are no
    number are NaN."""
    number = lambda c: F.col(c).try_cast("double")
    bad = [F.coalesce(F.isnan(number(c)) | (F.abs(number(c)) == float("inf")), F.lit(False)) for c in columns]
    malformed = bad[0]
    for b in bad[1:]:
        malformed = malformed | b
    return rows.withColumn("malformed", malformed).withColumns({c: F.coalesce(number(c), F.lit(float("nan"))) for c in columns})


def scan(spark: SparkSession, paths: list[str] | str, header_rule: HeaderRule) -> DataFrame:
    """session_id, path, seq, malformed and the channels as doubles of CSV files, each read by its own header.

    Rows with another number of fields than their file's header, or with a NaN or infinity anywhere, are malformed; a text
    that is no number becomes NaN, a channel that the file lacks is null. `seq` counts the file's rows that aren't
    malformed (null for the others) in file order. Every column is looked at before any is dropped, as a bad value in an
    unused one counts too. A file that has one header line and no more gives no rows.

    Files are read as lines and may be split: a line's place is the start of its split and its order within it. A split's
    rows are numbered by themselves and moved by the counts of the file's splits before it; only files of several splits are
    read once more for these counts. Each different header line comes to the driver once, to be resolved by `header_rule`.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line"), "value"
    )
    tops = lines.groupBy("path").agg(F.min_by("value", "line").alias("header"), F.min("line").alias("_top"), F.max("line.block").alias("_last_block"))
    headers = [r["header"] for r in tops.select("header").distinct().collect()]
    if not headers:
        raise ValueError("no file was found")
    places = {h: header_rule(h.split(",")) for h in headers}
    channels = sorted({c for found in places.values() for c in found}, key=lambda c: min(found.get(c, len(places)) for found in places.values()))
    widest = max(h.count(",") + 1 for h in headers)
    known = spark.createDataFrame([(h, h.count(",") + 1, [found.get(c) for c in channels]) for h, found in places.items()], "header string, fields int, places array<int>")
    files = tops.join(F.broadcast(known), "header").select("path", "_top", "_last_block", "fields", "places")  # one row for each dialect
    rows = lines.where("value <> ''").join(files, "path").where(F.col("line") != F.col("_top"))
    cells = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(widest))), {"mode": "PERMISSIVE"})
    size = F.size(F.split("value", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    rows = rows.select("path", "line", "_last_block", "fields", "places", size.alias("_n"), F.array(*[cells[f"c{i}"] for i in range(widest)]).alias("_texts"))
    number = F.transform("_texts", lambda x: x.try_cast("double"))
    rows = rows.withColumn("_numbers", number)
    odd = F.exists("_numbers", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)))
    rows = rows.withColumn("malformed", odd | (F.col("_n") != F.col("fields")))
    rows = rows.withColumn("_block", F.col("line.block"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.where("_last_block > 0").groupBy("path", "_block").agg(F.count_if(~F.col("malformed")).alias("_good"))
    moved = counts.select("path", "_block", F.sum("_good").over(before).alias("_before"))
    here = F.row_number().over(Window.partitionBy("path", "_block", "malformed").orderBy("line.n")) - 1
    rows = rows.join(moved, ["path", "_block"], "left")
    rows = rows.withColumn("seq", F.when(~F.col("malformed"), here + F.coalesce("_before", F.lit(0))).cast("long"))
    value = lambda k: F.when(F.col("places")[k].isNotNull(), F.coalesce(F.get("_numbers", F.col("places")[k]), F.lit(float("nan"))))
    return rows.select(file_session(F.col("path")).alias("session_id"), "path", "seq", "malformed", *[value(k).alias(c) for k, c in enumerate(channels)])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_session(path: Column) -> Column:
    """The name without .csv; a vehicle file has its phone file's."""
    return F.regexp_replace(F.regexp_replace(file_name(path), r"(?i)\.csv$", ""), "^V-", "S-")


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path of all files below a folder whose name fits, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path")


def matched_pairs(phones: DataFrame, vehicles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, phone, vehicle) and the phone files without a partner.

    A partner has the same name but for the first letter; one in the same folder comes first, then the first by path.
    """
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    left = phones.select(F.col("path").alias("phone"), file_session(F.col("path")).alias("session_id"))
    right = vehicles.select(F.col("path").alias("vehicle"), file_session(F.col("path")).alias("session_id"))
    met = left.join(right, "session_id").withColumn("_same", folder(F.col("phone")) == folder(F.col("vehicle")))
    best = F.row_number().over(Window.partitionBy("phone").orderBy(F.desc("_same"), "vehicle"))
    pairs = met.withColumn("_n", best).where("_n = 1").select("session_id", "phone", "vehicle")
    return pairs, left.join(pairs, "phone", "left_anti").select("session_id", "phone")


def malformed_by_file(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("path").agg(F.count_if("malformed").alias("malformed"), F.count(F.lit(1)).alias("rows"))


def windowed(phone: DataFrame, vehicle: DataFrame, size: int = 50, stride: int = 10) -> DataFrame:
    """Windows of paired recordings: session_id, window_idx, start_ms, end_ms, velocity_ms, rel_q, imu.

    Rows pair by their place among each file's good rows. The target is the last row's speed; rel_q is the turn from the
    first to the last row, zeros where the phone gave no orientation. Sessions shorter than a window give none.
    """
    rows = S.unwrap_resets(phone.where("not malformed"))
    angles = ("orient_yaw", "orient_pitch", "orient_roll")
    has = all(a in rows.columns for a in angles)
    pose = quat.from_euler_deg(*[F.col(a) for a in angles]) if has else quat.identity()
    rows = rows.withColumn("_q", pose).withColumns({c: F.col(c).cast("float") for c in IMU})
    speeds = vehicle.where("not malformed").select("session_id", "seq", kmh_to_ms(F.col("velocity_kmh")).cast("float").alias("_v"))
    windows = S.sliding_windows(S.positional_join(rows, speeds), list(IMU), size, stride, last=["time_ms", "_v", "_q"], first=["time_ms", "_q"])
    turn = quat.relative_xyz(F.col("first__q"), F.col("last__q"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    turn = (turn if has else zero).cast("struct<x:float,y:float,z:float>")
    return windows.select(
        "session_id", "window_idx", F.col("first_time_ms").alias("start_ms"), F.col("last_time_ms").alias("end_ms"), F.col("last__v").alias("velocity_ms"),
        turn.alias("rel_q"), "imu",
    )


def dataset_stats(windows: DataFrame) -> DataFrame:
    """One row: normalize_mean and normalize_std by channel (a sample counts once for each window that has it) and
    metadata_json with the numbers of windows and sessions."""
    found = window_channel_stats(windows, list(IMU)).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "std")))).alias("_m"))
    counts = windows.agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("session_id").alias("sessions"), F.lit(",".join(IMU)).alias("channels"))
    each = lambda part: F.array(*[F.col("_m")[c][part] for c in IMU])
    return found.select(each("mean").alias("normalize_mean"), each("std").alias("normalize_std"), F.lit(counts.toJSON().first()).alias("metadata_json"))


def write_windows(windows: DataFrame, path: str) -> None:
    """`windows` by session and `dataset_stats` below a folder. The windows are read back for the statistics."""
    windows.write.mode("errorifexists").partitionBy("session_id").parquet(f"{path}/windows")
    dataset_stats(windows.sparkSession.read.parquet(f"{path}/windows")).write.mode("errorifexists").parquet(f"{path}/dataset_stats")


def ground_truth(vehicle: DataFrame, windows: DataFrame, size: int = 50, stride: int = 10) -> DataFrame:
    """lat, lon and heading at the last row of each window. Rows count here if the three can be read (NaN stays), so the
    places can differ from the windows'; a window beyond the end takes the last row.

    `vehicle` is scanned rows with `line`, or any session_id, seq, lat, lon, heading_deg; `windows` names session_id and
    window_idx.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = vehicle.where("lat is not null and lon is not null and heading_deg is not null")
    rows = rows.withColumn("_at", F.row_number().over(order) - 1)
    counts = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    wanted = windows.select("session_id", "window_idx").join(counts, "session_id")
    wanted = wanted.withColumn("_at", F.least(F.col("window_idx") * stride + size - 1, F.col("_n") - 1))
    return wanted.join(rows.select("session_id", "_at", "lat", "lon", "heading_deg"), ["session_id", "_at"]).select("session_id", "window_idx", "lat", "lon", "heading_deg")
