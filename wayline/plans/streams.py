"""Live operators run over the event table: the stateful processors on a stream of its rows, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators import sequence as S
from wayline.operators.infer import infer
from wayline.plans import oracles as O
from wayline.plans.common import r
from wayline.plans.onnx_models import linear_over_window
from wayline.sources.events import raw_steps, table
from wayline.sources.live import last_known
from wayline.streaming import fleet as FL
from wayline.streaming import processors as P
from wayline.streaming.run import drained

SECOND = 1_000_000_000


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fixes, and every 20th and 27th of a user as commands."""
    steps = raw_steps(spark, sf)
    cmd = F.when(F.col("i") % 20 == 10, "start").when(F.col("i") % 20 == 17, "restore")
    return steps.select(F.col("session_id").alias("device"), (F.col("i") * SECOND).alias("ts_ns"), cmd.alias("cmd"))


def outage_fsm_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The mode after each row and the fixes skipped in the last outage, as window sums."""
    w = Window.partitionBy("device").orderBy("ts_ns")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _commands(spark, sf).withColumn("last_cmd", F.last("cmd", ignorenulls=True).over(upto))
    rows = rows.withColumn("part", F.count("cmd").over(upto)).withColumn("outage", F.count(F.when(F.col("cmd") == "start", 1)).over(upto))
    part = Window.partitionBy("device", "part").orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0)
    fixes = F.count(F.when(F.col("cmd").isNull(), 1)).over(part)
    mode = F.when(F.col("last_cmd").isNull(), "FIX").when(F.col("last_cmd") == "start", "OUTAGE").when(fixes > 0, "RECOVERED").otherwise("RECOVERING")
    hidden = F.when(F.col("cmd").isNull() & (F.col("last_cmd") == "start"), 1)
    skipped = F.count(hidden).over(Window.partitionBy("device", "outage").orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("device", "ts_ns", mode.alias("mode"), skipped.alias("skipped"))


def stream_outage_fsm(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the stateful processor on a stream; equal to `outage_fsm_batch`."""
    rows = drained(_commands(spark, sf), lambda s: P.run_stateful(s, P.OutageMachine(), P.OUTAGES))
    return rows.select("device", "ts_ns", "mode", "skipped")


def _sensors(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as an acceleration at its second and a rate half a second later."""
    steps = raw_steps(spark, sf)
    one = lambda name, late, *v: F.struct(F.lit(name).alias("sensor"), (F.col("i") * SECOND + late).alias("ts_ns"), F.array(*[x.cast("float") for x in v]).alias("values"))
    both = F.array(one("accel", 0, F.col("accel_x"), F.col("accel_y"), F.col("accel_z")), one("gyro", SECOND // 2, F.lit(0.0), F.lit(0.0), F.col("gyro_z")))
    return steps.select(F.col("session_id").alias("device"), F.inline(both))


def stream_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Grid samples of every device, from the stateful processor on a stream."""
    rows = drained(_sensors(spark, sf), lambda s: P.run_stateful(s, P.Resampler(), P.RESAMPLED))
    sums = {name: r(F.sum(F.col("sample")[i]), 3) for name, i in (("ax", 0), ("az", 2), ("gz", 5))}
    return rows.groupBy("device").agg(
        F.count(F.lit(1)).alias("samples"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), *[c.alias(n) for n, c in sums.items()],
        r(F.max_by("rate_hz", "ts_ns"), 6).alias("rate_hz"),
    )


def stream_infer(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor events to windows to a model's answer, all on one stream; whether each answer is the sum it stands for."""
    weights = [0.5, -0.25, 0.125, 0.0, 0.0, 1.0]
    model = linear_over_window(weights, P.CAPACITY)
    sample = lambda at: sum(w * F.get("imu", at + i) for i, w in enumerate(weights))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(6 * P.CAPACITY - 6), F.lit(6)), F.lit(0.0), lambda a, at: a + sample(at))
    sensors = _sensors(spark, sf)
    buckets = FL.bucket_count(sensors)

    def live(rows: DataFrame) -> DataFrame:
        windows = FL.run_bucketed(rows, FL.FleetWindows(flat=True), FL.FLAT_WINDOWS, buckets)
        return infer(windows, model, "imu", "predicted").withColumn("total", total).drop("imu")  # windows aren't written

    close = F.abs(F.col("predicted") - F.col("total") / P.CAPACITY) < 1e-4
    return drained(sensors, live).select("device", "ts_ns", "n", r("total", 4).alias("total"), close.alias("agrees"), r("window_rate_hz", 6).alias("window_rate_hz"))


def resample_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the grid must give: from the first rate to the last acceleration, every tenth of a second."""
    ends = _sensors(spark, sf).groupBy("device").agg(
        F.min(F.when(F.col("sensor") == "gyro", F.col("ts_ns"))).alias("first_ns"), F.max(F.when(F.col("sensor") == "accel", F.col("ts_ns"))).alias("last_ns")
    )
    ends = ends.where("last_ns >= first_ns").withColumn("samples", F.expr(f"(last_ns - first_ns) div {P.GRID_NS} + 1"))
    return ends.select("device", "samples", "first_ns", F.expr(f"first_ns + (samples - 1) * {P.GRID_NS}").alias("last_ns"))


def stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The online filter: fixes, samples and outage commands of every device on one stream; its last place."""
    steps = raw_steps(spark, sf).withColumn("ts_ns", F.col("i") * SECOND)
    cmd = F.when(F.col("i") % 40 == 20, "start").when(F.col("i") % 40 == 30, "restore")
    sample = F.array(F.lit(0.0), F.lit(0.0), F.col("accel_z"), F.lit(0.0), F.lit(0.0), -F.col("gyro_z"))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    parts = F.array(
        F.struct(F.lit("command").alias("kind"), cmd.alias("cmd"), none.alias("lat"), none.alias("lon"), none.alias("heading_deg"), F.lit(None).cast("array<double>").alias("sample")),
        F.struct(F.lit("fix").alias("kind"), text.alias("cmd"), (51.4778 + F.col("i") * 5e-5).alias("lat"), F.lit(-0.0014).alias("lon"), F.lit(0.0).alias("heading_deg"), F.lit(None).cast("array<double>").alias("sample")),
        F.struct(F.lit("sample").alias("kind"), text.alias("cmd"), none.alias("lat"), none.alias("lon"), none.alias("heading_deg"), sample.alias("sample")),
    )
    speed = F.struct(F.lit("speed").alias("kind"), text.alias("cmd"), none.alias("lat"), none.alias("lon"), none.alias("heading_deg"), F.array(F.lit(5.56)).alias("sample"))
    parts = F.concat(parts, F.array(speed))
    rows = steps.select(F.col("session_id").alias("device"), "ts_ns", F.inline(parts)).where("kind <> 'command' or cmd is not null")
    buckets = FL.bucket_count(rows)
    found = drained(rows, lambda s: FL.run_bucketed(s, FL.FleetFilter(), P.TRACK, buckets))
    last = found.groupBy("device").agg(F.max_by(F.struct("mode", "lat", "lon", "heading_deg", "speed_ms"), F.struct("ts_ns", "kind")).alias("x"), F.count_if("applied").alias("applied"))
    return last.select("device", "applied", "x.mode", r("x.lat", 6).alias("lat"), r("x.lon", 6).alias("lon"), r("x.speed_ms", 3).alias("speed_ms"))


def rate_meter_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return S.hop_windows(table(spark, sf, "events"), "ts", "1 day", "1 day", F.count(F.lit(1)).alias("n")).select("window_start", "n")


def hop_window_event_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.hop_windows(table(spark, sf, "events"), "ts", "4 days", "1 day", F.count(F.lit(1)).alias("n"), r(F.sum("value"), 3).alias("total"), keys=["event_type"])
    return rows.select("event_type", "window_start", "n", "total")


def last_known_location(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's freshest event, kept as a fix whose altitude is the event's number."""
    time = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * 1_000_000 + F.col("event_id")  # equal times by number
    fixes = table(spark, sf, "events").select(F.col("user_id").alias("device"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("event_id").alias("alt"), time.alias("ts_ns"))
    latest = last_known(fixes).select(F.col("device").alias("user_id"), F.col("alt").alias("event_id"))
    return latest.join(table(spark, sf, "events").select("event_id", "ts"), "event_id").select("user_id", "event_id", "ts")


QUERIES = {f.__name__: f for f in (
    outage_fsm_batch, stream_outage_fsm, stream_resample, stream_infer, resample_counts, stream_filter, rate_meter_tumbling, hop_window_event_time, last_known_location,
)}

_FSM = O.sql("""SELECT device, ts_ns, CASE WHEN last_cmd IS NULL THEN 'FIX' WHEN last_cmd = 'start' THEN 'OUTAGE' WHEN fixes > 0 THEN 'RECOVERED' ELSE 'RECOVERING' END AS mode, skipped FROM (
  SELECT *, count(*) FILTER (WHERE cmd IS NULL) OVER (PARTITION BY device, part ORDER BY ts_ns) AS fixes,
    count(*) FILTER (WHERE cmd IS NULL AND last_cmd = 'start') OVER (PARTITION BY device, outage ORDER BY ts_ns) AS skipped FROM (
  SELECT *, last_value(cmd IGNORE NULLS) OVER w AS last_cmd, count(cmd) OVER w AS part, count(*) FILTER (WHERE cmd = 'start') OVER w AS outage FROM (
  SELECT session_id AS device, i * 1000000000 AS ts_ns, CASE WHEN i % 20 = 10 THEN 'start' WHEN i % 20 = 17 THEN 'restore' END AS cmd FROM raw)
  WINDOW w AS (PARTITION BY device ORDER BY ts_ns)))""")
_HOPS = """SELECT event_type, day - INTERVAL (h) DAY AS window_start, count(*) AS n, {total} AS total FROM (SELECT *, date_trunc('day', ts) AS day FROM events), (SELECT unnest([0, 1, 2, 3]) AS h) GROUP BY 1, 2"""
#: Grid samples of both sensors, interpolated between the seconds and the half seconds that they were measured at.
_GRID = """, ends AS (SELECT session_id, (max(i) * 1000000000 - 500000000) // 100000000 + 1 AS samples FROM raw GROUP BY 1 HAVING max(i) > 0),
grid AS (SELECT session_id, unnest(range(samples)) AS g FROM ends),
spots AS (SELECT *, (g + 5) // 10 AS ia, ((g + 5) % 10) / 10.0 AS sa, g // 10 AS ig, (g % 10) / 10.0 AS sg, 500000000 + g * 100000000 AS ts_ns FROM grid),
f AS (SELECT session_id, i, CAST(CAST(accel_x AS FLOAT) AS DOUBLE) AS ax, CAST(CAST(accel_y AS FLOAT) AS DOUBLE) AS ay, CAST(CAST(accel_z AS FLOAT) AS DOUBLE) AS az, CAST(CAST(gyro_z AS FLOAT) AS DOUBLE) AS gz FROM raw),
lerped AS (
  SELECT p.session_id, p.g, p.ts_ns, a.ax + sa * (coalesce(b.ax, a.ax) - a.ax) AS ax, a.ay + sa * (coalesce(b.ay, a.ay) - a.ay) AS ay, a.az + sa * (coalesce(b.az, a.az) - a.az) AS az,
    c.gz + sg * (coalesce(d.gz, c.gz) - c.gz) AS gz
  FROM spots p JOIN f a ON a.session_id = p.session_id AND a.i = ia LEFT JOIN f b ON b.session_id = p.session_id AND b.i = ia + 1
  JOIN f c ON c.session_id = p.session_id AND c.i = ig LEFT JOIN f d ON d.session_id = p.session_id AND d.i = ig + 1)"""
ORACLES = {
    "stream_resample": O.sql(f"""{_GRID} SELECT session_id AS device, count(*) AS samples, CAST(min(ts_ns) AS BIGINT) AS first_ns, CAST(max(ts_ns) AS BIGINT) AS last_ns, {O.r("sum(ax)", 3)} AS ax,
      {O.r("sum(az)", 3)} AS az, {O.r("sum(gz)", 3)} AS gz, CASE WHEN count(*) > 20 THEN 10.0 WHEN count(*) > 10 THEN 11.0 ELSE 0.0 END AS rate_hz FROM lerped GROUP BY 1"""),
    "stream_infer": O.sql(f"""{_GRID}, sums AS (
      SELECT session_id, g, ts_ns, sum(0.5 * ax - 0.25 * ay + 0.125 * az + gz) OVER (PARTITION BY session_id ORDER BY g ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS total FROM lerped)
      SELECT session_id AS device, CAST(ts_ns AS BIGINT) AS ts_ns, g + 1 AS n, {O.r("total", 4)} AS total, true AS agrees,
        CASE WHEN g = 49 THEN 0.0 WHEN g = 59 THEN 2.0 ELSE 1.0 END AS window_rate_hz FROM sums WHERE g >= 49 AND (g - 49) % 10 = 0"""),
    "outage_fsm_batch": _FSM,
    "stream_outage_fsm": _FSM,
    "resample_counts": O.sql("""SELECT session_id AS device, CAST((max(i) * 1000000000 - 500000000) // 100000000 + 1 AS BIGINT) AS samples, 500000000::BIGINT AS first_ns,
      CAST(500000000 + ((max(i) * 1000000000 - 500000000) // 100000000) * 100000000 AS BIGINT) AS last_ns FROM raw GROUP BY 1 HAVING max(i) > 0"""),
    "rate_meter_tumbling": "SELECT date_trunc('day', ts) AS window_start, count(*) AS n FROM events GROUP BY 1",
    "hop_window_event_time": _HOPS.format(total=O.r("sum(value)", 3)),
    "last_known_location": "SELECT user_id, arg_max(event_id, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS event_id, max(ts) AS ts FROM events GROUP BY 1",
}
