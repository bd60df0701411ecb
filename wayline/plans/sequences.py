"""Windows, joins by position and time, statistics and splits over the event sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators import sequence as S
from wayline.operators import stats
from wayline.operators.storage import checkpoint_folder
from wayline.plans import oracles as O
from wayline.plans.common import CHUNK_ROWS, r, rounded
from wayline.sources.events import raw_steps, table
from wayline.sources.recordings import matched_pairs, phone_header, scan, valid_numbers

CHANNELS = ["accel_x", "accel_y", "accel_z"]


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return raw_steps(spark, sf).withColumnRenamed("i", "seq")


def count_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Each window's number of rows and channel sums."""
    windows = S.sliding_windows(samples(spark, sf), CHANNELS)
    total = lambda j: F.aggregate("imu", F.lit(0.0), lambda a, x: a + x[j])
    return rounded(windows.withColumn("n", F.size("imu").cast("long")), ["session_id", "window_idx", "n"], ax=total(0), ay=total(1), az=total(2))


def window_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds, last speed and mean yaw rate of each window."""
    rows = samples(spark, sf)
    ends = S.sliding_windows(rows, CHANNELS, last=["t_s", "true_speed"], first=["t_s"])
    mean = S.window_statistics(rows, {"gyro_mean": F.avg("gyro_z")})
    found = ends.join(mean, ["session_id", "window_idx"])
    return rounded(found, ["session_id", "window_idx"], start_s="first_t_s", end_s="last_t_s", velocity_ms="last_true_speed", gyro_mean="gyro_mean")


def timestamp_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """A clock that falls back every 17 steps, carried on."""
    rows = samples(spark, sf).withColumn("time_ms", (F.col("seq") % 17) * 100.0 + F.col("k"))
    return S.unwrap_resets(rows).select("session_id", "seq", "time_ms")


def timestamp_unwrap_chunked(spark: SparkSession, sf: str) -> DataFrame:
    """As timestamp_unwrap, without a task that sees a whole session."""
    rows = raw_steps(spark, sf, CHUNK_ROWS).withColumnRenamed("i", "seq")
    rows = rows.withColumn("time_ms", (F.col("seq") % 17) * 100.0 + F.col("k"))
    return S.unwrap_resets(rows, chunk=CHUNK_ROWS).select("session_id", "seq", "time_ms")


def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks and purchases of a user paired by position."""
    rows = table(spark, sf, "events").withColumn("session_id", F.col("user_id").cast("string"))
    side = lambda odd: S.numbered(rows.where(F.col("event_id") % 2 == odd), ["ts", "event_id"])
    left = side(0).select("session_id", "seq", F.col("event_id").alias("left_id"))
    return S.positional_join(left, side(1).select("session_id", "seq", F.col("event_id").alias("right_id")))


def first_differences(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.first_differences(samples(spark, sf), ["value"])
    return rounded(rows, ["session_id", "seq"], d_value="d_value")


def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """For each step, the step whose uneven time is nearest to 5 s before it, the earlier one on a tie."""
    rows = samples(spark, sf)
    left = rows.select("session_id", "seq", (F.col("t_s") - 5.0).alias("at"))
    right = rows.select("session_id", (F.col("t_s") + (F.col("k") % 7) / 4.0).alias("t"), F.col("seq").alias("hist"))
    found = S.nearest_as_of(left, right, "at", "t", ["hist"])
    return found.select("session_id", "seq", "matched_hist")


def resample_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    """Speeds at uneven times on a grid of a quarter second."""
    rows = samples(spark, sf).select("session_id", (F.col("t_s") + (F.col("k") % 7) / 16.0).alias("t"), F.col("true_speed").alias("v"))
    found = S.resample(rows, ["v"], 0.25)
    return rounded(found, ["session_id", "g", "t"], 9, v="v")


def channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of each channel over all samples of all windows."""
    found = stats.window_channel_stats(S.sliding_windows(samples(spark, sf), CHANNELS), CHANNELS)
    return rounded(found, ["channel"], mean="mean", std="std")


def volume_channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.channel_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    return rounded(found, ["l_returnflag", "channel"], 5, mean="mean", std="std")


def _parts() -> F.Column:
    """A split by rule that SQL can state: sessions in tenths by id."""
    tenth = F.col("session_id").cast("long") % 10
    return F.when(tenth < 8, "train").when(tenth == 8, "val").otherwise("test")


def train_split_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf)
    splits = rows.select("session_id").distinct().withColumn("split", _parts())
    train = rows.join(splits.where("split = 'train'"), "session_id", "left_semi")
    return rounded(stats.channel_stats(train, [*CHANNELS, "gyro_z", "true_speed"]), ["channel"], mean="mean", std="std")


def partition_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.partition_stats(samples(spark, sf).withColumn("split", _parts()), "true_speed", ["split"])
    return rounded(found, ["split", "n"], 5, **{c: c for c in found.columns if c not in ("split", "n")})


def seeded_session_split(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and sessions of each part of the seeded split."""
    rows = S.sliding_windows(samples(spark, sf), CHANNELS)
    met = rows.join(stats.session_splits(rows), "session_id")
    return met.groupBy("split").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("session_id").alias("sessions"))


def hashed_session_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every session's part in the split by seeded md5."""
    return stats.hash_splits(samples(spark, sf)).select("session_id", "split")


def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that two parts share: none."""
    parts = samples(spark, sf).select("session_id", _parts().alias("split")).distinct()
    side = lambda name: parts.where(F.col("split") == name).select("session_id")
    return side("train").intersect(side("val")).unionByName(side("train").intersect(side("test")))


def speed_mae_huber(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.speed_scores(samples(spark, sf), "speed_ms", "true_speed", ["event_type"])
    return rounded(found, ["event_type"], mae_ms="mae_ms", mae_kmh="mae_kmh", smooth_l1="smooth_l1")


def session_pairing_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as phone files in folders by key, orders as vehicle files in folders by status: the partner in the same
    folder, else the first by path, and phone files without one."""
    key = F.col("c_custkey")
    phones = table(spark, sf, "customer").select(F.concat(F.lit("/rec/"), F.when(key % 2 == 0, "F").otherwise("P"), F.lit("/S-"), key.cast("string"), F.lit(".csv")).alias("path"))
    files = table(spark, sf, "orders").select(F.concat(F.lit("/rec/"), "o_orderstatus", F.lit("/V-"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"))
    pairs, alone = matched_pairs(phones, files.distinct())
    return pairs.unionByName(alone, allowMissingColumns=True)


#: Recordings that the sessions are written to by user, in two dialects of header.
RECORDINGS = 16
_DIALECTS = (
    "Time Since Start (ms),Date,Accelerometer X,Accelerometer Y,Accelerometer Z,Gyroscope Yaw,Gyroscope Pitch,Gyroscope Roll",
    "Gyroscope X (rad/s),Accelerometer Z,Accelerometer X,Note,Time Since Start (ms),Gyroscope Z (rad/s),Accelerometer Y,Gyroscope Y (rad/s),GRAVITY X",
)


def recordings_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The steps written as CSV files, every other one in another dialect with its columns in another order, with broken
    rows among them, and scanned again all at once: each by its own header."""
    rows = samples(spark, sf).withColumn("rec", F.col("session_id").cast("long") % RECORDINGS)
    broken = F.when(F.col("event_id") % 13 == 0, "nan").when(F.col("event_id") % 17 == 0, "1,2").when(F.col("event_id") % 19 == 0, "text").otherwise("0")
    number = lambda c: F.col(c).cast("string")
    time = (F.col("t_s") * 100).cast("string")
    first = F.concat_ws(",", time, broken, number("accel_x"), number("accel_y"), number("accel_z"), F.lit("0"), F.lit("0"), number("gyro_z"))
    second = F.concat_ws(",", F.lit("0"), number("accel_z"), number("accel_x"), broken, time, number("gyro_z"), number("accel_y"), F.lit("0"), number("value"))
    line = F.when(F.col("rec") % 2 == 0, first).otherwise(second)
    tops = spark.range(RECORDINGS).select(F.col("id").alias("rec"), F.lit(-1).cast("long").alias("event_id"), F.when(F.col("id") % 2 == 0, _DIALECTS[0]).otherwise(_DIALECTS[1]).alias("value"))
    lines = tops.unionByName(rows.select("rec", "event_id", line.alias("value")))
    folder = f"{checkpoint_folder(spark)}/recordings-{uuid.uuid4().hex}"
    lines.repartition("rec").sortWithinPartitions("rec", "event_id").select("rec", "value").write.partitionBy("rec").text(folder)
    found = scan(spark, folder, phone_header)
    rec = F.regexp_extract("path", "rec=([0-9]+)", 1).cast("int").alias("rec")
    return rounded(found.where("not malformed"), [rec, "seq"], 9, **{c: c for c in ("time_ms", "accel_x", "accel_y", "accel_z", "gyro_z")}, gravity_x="gravity_x")


def session_selection_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Preferred sessions that exist, or else the first three."""
    ids = samples(spark, sf).select("session_id").distinct()
    preferred = spark.createDataFrame([("3",), ("7",), ("no such",)], "session_id string")
    found = ids.join(F.broadcast(preferred), "session_id", "left_semi")
    some = found.agg((F.count(F.lit(1)) > 0).alias("some"))
    other = ids.orderBy("session_id").limit(3)
    return found.unionByName(other.crossJoin(F.broadcast(some)).where("not some").select("session_id"))


def prefix_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 steps of each session."""
    return samples(spark, sf).where("seq < 20").select("session_id", "seq", "event_id")


def tolerant_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as numbers: a row with a NaN or infinity is malformed, an unreadable text is NaN and stays."""
    k = F.col("event_id") % 5
    token = F.when(k == 0, "nan").when(k == 1, "inf").when(k == 2, F.concat(F.lit("x"), "event_type")).when(k == 3, "").otherwise(F.col("value").cast("string"))
    rows = table(spark, sf, "events").select("event_id", token.alias("token"))
    found = valid_numbers(rows, ["token"])
    return found.select("event_id", "malformed", r(F.when(~F.col("malformed") & ~F.isnan("token"), F.col("token"))).alias("value"))


def malformed_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tolerant_parse(spark, sf)
    return rows.groupBy("malformed").agg(F.count(F.lit(1)).alias("n"))


def sample_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of three finite values."""
    reading = F.array(F.col("accel_x"), F.col("accel_y"), F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("accel_z")))
    rows = samples(spark, sf).select("event_id", F.when(F.col("event_id") % 17 == 0, F.slice(reading, 1, 2)).otherwise(reading).alias("v"))
    ok = (F.size("v") == 3) & F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(ok).select("event_id")


def speed_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(samples(spark, sf), ["event_id"], speed=F.greatest(F.lit(0.0), F.col("speed_ms") - 6.0))


def zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised speed by the whole table's statistics, and back."""
    rows = samples(spark, sf)
    found = rows.crossJoin(F.broadcast(stats.channel_stats(rows, ["true_speed"])))  # one row
    z = stats.z_score(F.col("true_speed"), F.col("mean"), F.col("std"))
    return rounded(found, ["event_id"], z=z, back=stats.denormalised(z, F.col("mean"), F.col("std")))


def column_parity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.parity(samples(spark, sf), "speed_ms", "true_speed"), [], max_abs_diff="max_abs_diff", mean_abs_diff="mean_abs_diff")


QUERIES = {f.__name__: f for f in (
    count_sliding_windows, window_targets, timestamp_unwrap, timestamp_unwrap_chunked, positional_join, first_differences, asof_nearest, resample_interpolate, channel_stats,
    volume_channel_stats, train_split_stats, partition_stats, seeded_session_split, hashed_session_split, split_disjoint, speed_mae_huber, session_pairing_anti, recordings_scan,
    session_selection_semi, prefix_limit, tolerant_parse, malformed_counts, sample_validity, speed_clamp, zscore, column_parity,
)}

_TOKEN = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'bad' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE CAST(value AS VARCHAR) END AS v FROM events"""
_STATS = lambda rows, channels: " UNION ALL ".join(
    f"SELECT '{c}' AS channel, {O.r(f'avg({c})')} AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE {O.r(f'stddev_pop({c})')} END AS std FROM {rows}" for c in channels
)
_PART = "CASE WHEN CAST(session_id AS BIGINT) % 10 < 8 THEN 'train' WHEN CAST(session_id AS BIGINT) % 10 = 8 THEN 'val' ELSE 'test' END"
_FIGURES = ", ".join(
    f"{O.r(f'{f}(true_speed) * {k}', 5)} AS {n}_{u}"
    for u, k in (("ms", "1.0"), ("kmh", "3.6")) for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
)
ORACLES = {
    "count_sliding_windows": O.sql(f"SELECT session_id, window_idx, n, {O.r('ax')} AS ax, {O.r('ay')} AS ay, {O.r('az')} AS az FROM count_windows"),
    "window_targets": O.sql(f"SELECT session_id, window_idx, {O.r('start_s')} AS start_s, {O.r('end_s')} AS end_s, {O.r('true_speed')} AS velocity_ms, {O.r('gyro_mean')} AS gyro_mean FROM count_windows"),
    "timestamp_unwrap": O.sql("""SELECT session_id, seq, t + coalesce(sum(jump) OVER (PARTITION BY session_id ORDER BY seq), 0.0) AS time_ms FROM (
      SELECT *, CASE WHEN t < p THEN p + (CASE WHEN p - pp > 0 THEN p - pp ELSE 100.0 END) - t ELSE 0.0 END AS jump FROM (
      SELECT session_id, seq, t, lag(t) OVER w AS p, lag(t, 2) OVER w AS pp FROM (SELECT session_id, i AS seq, CAST((i % 17) * 100 + k AS DOUBLE) AS t FROM raw)
      WINDOW w AS (PARTITION BY session_id ORDER BY seq)))"""),
    "positional_join": """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, event_id % 2 AS odd,
      row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS seq FROM events)
      SELECT a.session_id, a.seq, a.event_id AS left_id, b.event_id AS right_id FROM n a JOIN n b USING (session_id, seq) WHERE a.odd = 0 AND b.odd = 1""",
    "first_differences": O.sql(f"SELECT session_id, i AS seq, {O.r('d')} AS d_value FROM (SELECT session_id, i, value - lag(value) OVER (PARTITION BY session_id ORDER BY i) AS d FROM raw)"),
    "asof_nearest": O.sql("""SELECT session_id, seq, hist AS matched_hist FROM (
      SELECT a.session_id, a.i AS seq, b.i AS hist, row_number() OVER (PARTITION BY a.session_id, a.i ORDER BY abs(a.t_s - 5.0 - (b.t_s + (b.k % 7) / 4.0)), b.t_s + (b.k % 7) / 4.0, b.i) AS n
      FROM raw a JOIN raw b ON a.session_id = b.session_id) WHERE n = 1"""),
    "resample_interpolate": O.sql(f"""SELECT session_id, g, t0 + g * 0.25 AS t, {O.r("CASE WHEN nt IS NULL OR nt <= t THEN v ELSE v + (t0 + g * 0.25 - t) / (nt - t) * (nv - v) END", 9)} AS v FROM (
      SELECT *, unnest(range(lo, hi + 1)) AS g FROM (
      SELECT *, CAST(ceil((t - t0) / 0.25 - 1e-9) AS BIGINT) AS lo, CAST(CASE WHEN nt IS NULL THEN floor((t - t0) / 0.25 + 1e-9) ELSE ceil((nt - t0) / 0.25 - 1e-9) - 1 END AS BIGINT) AS hi FROM (
      SELECT session_id, t, v, min(t) OVER (PARTITION BY session_id) AS t0, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM (
      SELECT session_id, t_s + (k % 7) / 16.0 AS t, true_speed AS v FROM raw) WINDOW w AS (PARTITION BY session_id ORDER BY t))) WHERE lo <= hi)"""),
    "channel_stats": O.sql(", members AS (SELECT r.accel_x, r.accel_y, r.accel_z FROM raw r JOIN count_windows w ON w.session_id = r.session_id AND r.i BETWEEN w.i - 49 AND w.i) " + _STATS("members", CHANNELS)),
    "volume_channel_stats": " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS channel, {O.r(f'avg({c})', 5)} AS mean, {O.r(f'stddev_pop({c})', 5)} AS std FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_discount", "l_tax")),
    "train_split_stats": O.sql(f", train AS (SELECT * FROM raw WHERE {_PART} = 'train') " + _STATS("train", [*CHANNELS, "gyro_z", "true_speed"])),
    "partition_stats": O.sql(f"SELECT {_PART} AS split, count(*) AS n, {_FIGURES} FROM raw GROUP BY 1"),
    "split_disjoint": O.sql("SELECT session_id FROM raw WHERE 1 = 0"),
    "speed_mae_huber": O.sql(f"""SELECT event_type, {O.r("avg(g)")} AS mae_ms, {O.r("avg(g) * 3.6")} AS mae_kmh, {O.r("avg(CASE WHEN g < 1 THEN 0.5 * g * g ELSE g - 0.5 END)")} AS smooth_l1
      FROM (SELECT event_type, abs(speed_ms - true_speed) AS g FROM raw) GROUP BY 1"""),
    "hashed_session_split": O.sql("""SELECT session_id, CASE WHEN place < n - 2 * t THEN 'train' WHEN place < n - t THEN 'val' ELSE 'test' END AS split FROM (
      SELECT session_id, row_number() OVER (ORDER BY md5('42:' || session_id), session_id) - 1 AS place, count(*) OVER () AS n, greatest(1, CAST(round_even(count(*) OVER () * 0.1, 0) AS BIGINT)) AS t
      FROM (SELECT DISTINCT session_id FROM raw))"""),
    "session_pairing_anti": """WITH p AS (SELECT 'S-' || c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'P' END AS folder FROM customer),
      v AS (SELECT DISTINCT 'S-' || o_custkey AS session_id, o_orderstatus AS folder, '/rec/' || o_orderstatus || '/V-' || o_custkey || '.csv' AS vehicle FROM orders),
      met AS (SELECT p.session_id, p.folder, v.vehicle, row_number() OVER (PARTITION BY p.session_id ORDER BY (p.folder = v.folder) DESC, v.vehicle) AS n FROM p LEFT JOIN v USING (session_id))
      SELECT session_id, '/rec/' || folder || '/' || session_id || '.csv' AS phone, vehicle FROM met WHERE n = 1""",
    "recordings_scan": O.sql(f"""SELECT CAST(rec AS INT) AS rec, row_number() OVER (PARTITION BY rec ORDER BY event_id) - 1 AS seq, {O.r("t_s * 100", 9)} AS time_ms,
      {', '.join(f"{O.r(c, 9)} AS {c}" for c in ("accel_x", "accel_y", "accel_z", "gyro_z"))}, CASE WHEN rec % 2 = 1 THEN {O.r("value", 9)} END AS gravity_x
      FROM (SELECT *, CAST(session_id AS BIGINT) % {RECORDINGS} AS rec FROM raw) WHERE event_id % 13 <> 0 AND event_id % 17 <> 0"""),
    "session_selection_semi": O.sql("""SELECT session_id FROM (SELECT DISTINCT session_id FROM raw) WHERE session_id IN ('3', '7') OR (
      NOT EXISTS (SELECT 1 FROM raw WHERE session_id IN ('3', '7')) AND session_id IN (SELECT DISTINCT session_id FROM raw ORDER BY 1 LIMIT 3))"""),
    "prefix_limit": O.sql("SELECT session_id, i AS seq, event_id FROM raw WHERE i < 20"),
    "tolerant_parse": f"SELECT event_id, coalesce(v = 'bad', false) AS malformed, {O.r('TRY_CAST(v AS DOUBLE)')} AS value FROM ({_TOKEN})",
    "malformed_counts": f"SELECT coalesce(v = 'bad', false) AS malformed, count(*) AS n FROM ({_TOKEN}) GROUP BY 1",
    "sample_validity": "SELECT event_id FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0",
    "speed_clamp": O.sql(f"SELECT event_id, {O.r('greatest(0.0, speed_ms - 6.0)')} AS speed FROM raw"),
    "zscore": O.sql(f"""SELECT event_id, {O.r("(true_speed - m) / s")} AS z, {O.r("true_speed")} AS back FROM raw, (SELECT avg(true_speed) AS m, stddev_pop(true_speed) AS s FROM raw)"""),
    "column_parity": O.sql(f"SELECT {O.r('max(abs(speed_ms - true_speed))')} AS max_abs_diff, {O.r('avg(abs(speed_ms - true_speed))')} AS mean_abs_diff FROM raw"),
}
ORACLES["timestamp_unwrap_chunked"] = ORACLES["timestamp_unwrap"]
