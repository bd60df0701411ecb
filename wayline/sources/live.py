"""Streams of sensor readings, satellite fixes and outage commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.schemas import GNSS_FIXES, OUTAGE_COMMANDS, SENSOR_EVENTS

SCHEMAS = {"sensor_events": SENSOR_EVENTS, "gnss_fixes": GNSS_FIXES, "outage_commands": OUTAGE_COMMANDS}


def stream(spark: SparkSession, kind: str, path: str, files_per_batch: int = 1000, fmt: str = "json") -> DataFrame:
    """Files of one kind that arrive in a folder; at most so many go to a batch, which bounds what waits for the next."""
    return spark.readStream.schema(SCHEMAS[kind]).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def topic(spark: SparkSession, kind: str, servers: str, name: str, offsets_per_batch: int = 1_000_000) -> DataFrame:
    """One kind as JSON values of a Kafka topic (needs Spark's Kafka package on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name)
    raw = raw.option("maxOffsetsPerTrigger", offsets_per_batch).load()
    return raw.select(F.from_json(F.col("value").cast("string"), SCHEMAS[kind]).alias("v")).select("v.*")


def with_time(rows: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Add `ts`, the event time, and its watermark."""
    return rows.withColumn("ts", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long"))).withWatermark("ts", late)


def last_known(fixes: DataFrame) -> DataFrame:
    """The freshest fix of each device."""
    return fixes.groupBy("device").agg(F.max_by(F.struct("lat", "lon", "alt", "ts_ns"), "ts_ns").alias("_f")).select("device", "_f.*")
