"""The live loop over the event table: rows that come unordered, windows that drive the filter, the latch on windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.plans import oracles as O
from wayline.plans import streams
from wayline.plans.common import r
from wayline.sources.events import raw_steps
from wayline.streaming import fleet as FL
from wayline.streaming import ordered as OR
from wayline.streaming import processors as P
from wayline.streaming.run import drained

SECOND = 1_000_000_000
NONE = {"lat": "double", "lon": "double", "heading_deg": "double", "sample": "array<double>", "cmd": "string"}


def _row(kind: str, late_ns: int = 0, **values: Column) -> Column:
    cells = {c: values[c].cast(t) if c in values else F.lit(None).cast(t) for c, t in NONE.items()}
    return F.struct((F.col("i") * SECOND + late_ns).alias("ts_ns"), F.lit(kind).alias("kind"), *[cells[c].alias(c) for c in ("cmd", "lat", "lon", "heading_deg", "sample")])


def _unordered_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `outage_fsm_batch`, each up to seven places from where it belongs."""
    rows = streams._commands(spark, sf).withColumn("i", F.col("ts_ns").cast("long") / SECOND)
    rows = rows.select("device", F.inline(F.array(_row("event", cmd=F.col("cmd")))))
    return rows.select("device", F.col("ts_ns").cast("long").alias("ts_ns"), *OR.FIELDS).withColumn("arrival", F.expr(f"ts_ns div {SECOND} + ts_ns div {SECOND} * 5 % 8"))


def stream_unordered_fsm(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered rows put in order on the stream, then the outage machine; equal to `outage_fsm_batch` of sorted rows."""
    plan = lambda s: P.run_stateful(OR.in_order(s.drop("arrival")).where("not late").select("device", "ts_ns", "cmd"), P.OutageMachine(), P.OUTAGES)
    rows = drained(_unordered_commands(spark, sf), plan, 3, "arrival", OR.end_of_stream(spark))
    return rows.select("device", "ts_ns", "mode", "skipped")


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 1, 3 and 5 of the longer sessions come when later ones have long been given out: how many rows of each device
    were in order, and how many late."""
    rows = _unordered_commands(spark, sf)
    size = rows.groupBy("device").agg(F.count(F.lit(1)).alias("n"))
    held_back = F.expr(f"n >= 40 and ts_ns div {SECOND} in (1, 3, 5)")
    rows = rows.join(size, "device").withColumn("arrival", F.when(held_back, F.lit(10**9)).otherwise(F.col("arrival"))).drop("n")
    found = drained(rows, lambda s: OR.in_order(s.drop("arrival")), 4, "arrival", OR.end_of_stream(spark))
    return found.groupBy("device").agg(F.count_if(~F.col("late")).alias("in_order"), F.count_if("late").alias("late"))


def loop_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as two readings, every fifth as a fix, and outages by command, up to three rows from their place."""
    steps = raw_steps(spark, sf).withColumn("session_id", F.col("session_id"))
    cmd = F.when(F.col("i") % 40 == 20, "start").when(F.col("i") % 40 == 30, "restore")
    parts = F.array(
        _row("accel", sample=F.array(F.lit(0.0), F.lit(0.0), F.col("accel_z"))), _row("gyro", SECOND // 2, sample=F.array(F.lit(0.0), F.lit(0.0), -F.col("gyro_z"))),
        _row("fix", SECOND // 4, lat=51.4778 + F.col("i") * 5e-5, lon=F.lit(-0.0014), heading_deg=F.lit(0.0)), _row("command", cmd=cmd),
    )
    rows = steps.select(F.col("session_id").alias("device"), "i", F.inline(parts)).where("(kind <> 'fix' or i % 5 = 0) and (kind <> 'command' or cmd is not null)").drop("i")
    return rows.select("device", "ts_ns", *OR.FIELDS).withColumn("arrival", F.expr(f"ts_ns div {SECOND // 4} + ts_ns div {SECOND // 4} * 3 % 5"))


def window_speed() -> Column:
    """A window's speed, standing in for a model: 5 m/s and the mean of its vertical excess."""
    vertical = F.sequence(F.lit(2), F.lit(6 * P.CAPACITY - 1), F.lit(6))
    return 5 + F.aggregate(vertical, F.lit(0.0), lambda s, i: s + F.col("imu")[i]) / P.CAPACITY - 9.80665


def stream_closed_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered readings, fixes and commands to order, windows, measurements and the filter on one stream: the last place
    of each device, and how many measurements its windows gave."""
    rows = loop_rows(spark, sf)
    buckets = FL.bucket_count(rows)
    found = drained(rows, lambda s: OR.closed_loop(s.drop("arrival"), window_speed(), buckets=buckets, last=True), 3, "arrival", OR.end_of_stream(spark))
    last = found.groupBy("device").agg(
        F.max_by(F.struct("mode", "lat", "lon", "heading_deg", "speed_ms"), F.struct("ts_ns", "kind")).alias("x"),
        *[F.sum(c).alias(c) for c in ("fixes", "speeds", "turns")],
    )
    return last.select("device", "fixes", "speeds", "turns", "x.mode", r("x.lat", 7).alias("lat"), r("x.lon", 7).alias("lon"), r("x.speed_ms", 4).alias("speed_ms"))


def stream_newest_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The newest window of each device in each batch, and how many it has skipped so far."""
    sensors = streams._sensors(spark, sf)
    buckets = FL.bucket_count(sensors)
    rows = drained(sensors, lambda s: FL.run_bucketed(s, FL.FleetWindows(newest=True), P.NEWEST_WINDOWS, buckets))
    return rows.select("device", "ts_ns", "n", "skipped")


QUERIES = {f.__name__: f for f in (stream_unordered_fsm, stream_late_rows, stream_closed_loop, stream_newest_windows)}
ORACLES = {
    "stream_unordered_fsm": streams.ORACLES["outage_fsm_batch"],
    "stream_late_rows": O.sql("""SELECT session_id AS device, count(*) - CASE WHEN count(*) >= 40 THEN 3 ELSE 0 END AS in_order, CAST(CASE WHEN count(*) >= 40 THEN 3 ELSE 0 END AS BIGINT) AS late FROM raw GROUP BY 1"""),
    # Two batches by halves of a device's rows; a half reaches as far as the earlier of its two sensors.
    "stream_newest_windows": O.sql("""SELECT device, 500000000 + g * 100000000 AS ts_ns, g + 1 AS n, CAST(sum(w - 1) OVER (PARTITION BY device ORDER BY g) AS BIGINT) AS skipped FROM (
      SELECT device, batch, max(g) AS g, count(*) AS w FROM (
        SELECT device, g, CASE WHEN 500000000 + g * 100000000 <= first_end THEN 1 ELSE 2 END AS batch FROM (
          SELECT session_id AS device, max(i) * 1000000000 AS last_end, least(((count(*) - 1) // 2) * 1000000000, (count(*) // 2 - 1) * 1000000000 + 500000000) AS first_end FROM raw GROUP BY 1) e,
          range(49, 200000, 10) s(g) WHERE 500000000 + g * 100000000 <= last_end) GROUP BY 1, 2)"""),
}
