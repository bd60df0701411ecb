"""Results as files: nested JSON documents, flat CSV, and the tables behind the usual figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def json_report(summary: DataFrame, by: list[str], metrics: list[str], places: int = 3) -> DataFrame:
    """One text column `report`: {"<first key>": {"<second key>": {metric: value}}} (or one level), keys sorted."""
    value = F.struct(*[F.round(m, places).alias(m) for m in metrics])
    rows = summary.select(*[F.col(k).cast("string").alias(k) for k in by], value.alias("_v"))
    for depth in range(len(by) - 1, -1, -1):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(by[depth]).alias("k"), F.col("_v").alias("v"))), _by_key)
        rows = rows.groupBy(*by[:depth]).agg(F.map_from_entries(pairs).alias("_v"))
    return rows.select(F.to_json("_v").alias("report"))


def write_json(report: DataFrame, path: str) -> None:
    report.select(F.col("report").alias("value")).write.mode("errorifexists").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON report, or None if it isn't there or can't be read."""
    try:
        rows = spark.read.option("multiLine", True).json(path)
        return rows if rows.columns and rows.columns != ["_corrupt_record"] else None
    except Exception:  # noqa: BLE001  Spark reports a missing path in several ways
        return None


def error_bars(summary: DataFrame, version: str) -> DataFrame:
    """Bars of final error and of drift by duration."""
    return summary.select(F.lit(version).alias("version"), "duration_s", "final_error_m", "relative_drift_percent")


def error_lines(points: DataFrame) -> DataFrame:
    """Mean error by second of the outage."""
    rows = points.withColumn("elapsed_s", F.col("t_s") - F.col("start_s"))
    return rows.groupBy("duration_s", "elapsed_s").agg(F.avg("error_m").alias("error_m"), F.count(F.lit(1)).alias("n"))


def track_lines(points: DataFrame, session: str, duration: int) -> DataFrame:
    """True and estimated places of one session in order."""
    own = points.where((F.col("session_id") == session) & (F.col("duration_s") == duration))
    return own.select("i", "t_s", "gt_lat", "gt_lon", "lat", "lon", "is_blackout").orderBy("i")
