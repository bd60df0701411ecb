"""A made-up straight drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions.geo import EARTH_RADIUS_M


def straight_drive(
    spark: SparkSession, duration_s: float = 60.0, rate_hz: float = 10.0, speed_ms: float = 10.0, lat: float = 51.4778, lon: float = -0.0014,
    heading_deg: float = 45.0, noise: float = 0.0, gyro_noise: float = 0.0, seed: int = 42,
) -> DataFrame:
    """session_id, i, t_s, speed_ms, gyro_z, gt_lat, gt_lon, gt_heading_deg of a drive at constant speed and heading.

    Times run evenly from 0 to the duration; each row moves by one period of the rate, east scaled at the latitude it has
    come to. Noise is added to speed and yaw rate only.
    """
    n = int(duration_s * rate_hz)
    rows = spark.range(n).select(F.lit("synthetic").alias("session_id"), F.col("id").alias("i"))
    step, turn = speed_ms / rate_hz, F.radians(F.lit(heading_deg))
    north = F.radians(F.lit(lat)) + F.col("i") * step * F.cos(turn) / EARTH_RADIUS_M
    rows = rows.withColumn("_lat", north)
    east = F.when(F.col("i") == 0, 0.0).otherwise(step * F.sin(turn) / (EARTH_RADIUS_M * F.cos("_lat")))
    upto = Window.partitionBy("session_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "session_id", "i", (F.col("i") * (duration_s / max(1, n - 1))).alias("t_s"),
        (F.lit(speed_ms) + (F.randn(seed) * noise if noise else F.lit(0.0))).alias("speed_ms"),
        (F.randn(seed + 1) * gyro_noise if gyro_noise else F.lit(0.0)).alias("gyro_z"),
        F.degrees("_lat").alias("gt_lat"), F.degrees(F.radians(F.lit(lon)) + F.sum(east).over(upto)).alias("gt_lon"),
        F.lit(heading_deg).alias("gt_heading_deg"),
    )
