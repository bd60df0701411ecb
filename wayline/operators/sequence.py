"""Ordered rows of a session: numbering, unwrapping, sliding windows, as-of and resampling joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.scans import lagged, running


def by_session(order: str, key: str | list[str] = "session_id"):
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dealt by key to as many partitions as the session shuffles to. Groups that are slow to work on but small to move
    would otherwise be coalesced by their bytes into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, order: list[str], key: str = "session_id", into: str = "seq") -> DataFrame:
    """Rows of each session counted from 0 in the given order."""
    return df.withColumn(into, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def unwrap_resets(df: DataFrame, time: str = "time_ms", into: str = "time_ms", step: float = 100.0, chunk: int | None = None) -> DataFrame:
    """Carry on the clock over resets: at each step back, add what the step back lost plus the step before it (or `step`
    if that wasn't forward); all later rows keep the sum. The unwrapped clock never runs back. With `chunk` a session is cut
    into pieces of so many rows, so that none has to fit into a task."""
    w, keys = by_session("seq"), ["session_id"]
    if chunk:
        df = lagged(df, keys, "seq", chunk, {"_last": (time, 1), "_second": (time, 2)})
    else:
        df = df.withColumns({"_last": F.lag(time, 1).over(w), "_second": F.lag(time, 2).over(w)})
    now, last, second = F.col(time), F.col("_last"), F.col("_second")
    before = F.when(last - second > 0, last - second).otherwise(F.lit(step))
    jump = F.when(now < last, last + before - now).otherwise(F.lit(0.0))
    df = df.withColumn("_jump", jump)
    if chunk:
        df = running(df, keys, "seq", chunk, {"_shift": F.col("_jump")})
    else:
        df = df.withColumn("_shift", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(into, now + F.col("_shift")).drop("_last", "_second", "_jump", "_shift")


def positional_join(left: DataFrame, right: DataFrame, key: str = "session_id") -> DataFrame:
    """Row n of one recording with row n of the other; the longer one's tail goes."""
    return left.join(right, [key, "seq"])


def sliding_windows(samples: DataFrame, channels: list[str], size: int = 50, stride: int = 10, last: list[str] = (), first: list[str] = ()) -> DataFrame:
    """Count-based windows: session_id, window_idx, `imu` (size rows of channels), first_<c> and last_<c>.

    A window is the frame of `size` rows that ends at its last row, so one sort of each session serves all windows and
    sessions shorter than `size` give none.
    """
    w = by_session("seq")
    frame = w.rowsBetween(-(size - 1), 0)
    rows = samples.withColumn("_row", F.array(*[F.col(c) for c in channels]))
    ends = rows.withColumn("imu", F.collect_list("_row").over(frame))
    for c in first:
        ends = ends.withColumn(f"first_{c}", F.lag(c, size - 1).over(w))
    ends = ends.where((F.col("seq") >= size - 1) & ((F.col("seq") - (size - 1)) % stride == 0))
    idx = ((F.col("seq") - (size - 1)) / stride).cast("long").alias("window_idx")
    return ends.select("session_id", idx, "imu", *[f"first_{c}" for c in first], *[F.col(c).alias(f"last_{c}") for c in last])


def window_statistics(samples: DataFrame, aggregates: dict[str, Column], size: int = 50, stride: int = 10) -> DataFrame:
    """Aggregates of each count-based window without building it: an aggregate over the frame that ends at its last row."""
    frame = by_session("seq").rowsBetween(-(size - 1), 0)
    out = samples
    for name, aggregate in aggregates.items():
        out = out.withColumn(name, aggregate.over(frame))
    out = out.where((F.col("seq") >= size - 1) & ((F.col("seq") - (size - 1)) % stride == 0))
    return out.select("session_id", ((F.col("seq") - (size - 1)) / stride).cast("long").alias("window_idx"), *aggregates)


def first_differences(df: DataFrame, columns: list[str], order: str = "seq", key: str = "session_id") -> DataFrame:
    w = by_session(order, key)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def nearest_as_of(left: DataFrame, right: DataFrame, at: str, time: str, values: list[str], key: str = "session_id") -> DataFrame:
    """Each left row with the right row of its session nearest in time to `at`; on a tie the earlier one.

    Both sides are one sorted stream: the last right row up to a left row and the first from it on are frames' values,
    so nothing is compared pairwise. Among right rows at one time the first in order of `values` counts.
    """
    packed = F.struct(F.col(time).alias("t"), *values)
    one = right.groupBy(key, F.col(time).alias("_t")).agg(F.min(packed).alias("_v"))
    asked = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns]))
    both = asked.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), "_row", F.lit(None).cast(one.schema["_v"].dataType).alias("_v")).unionByName(
        one.select(key, "_t", F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "_v")
    )
    # Both frames grow row by row; one that shrank would be gone through anew for every row.
    back, ahead = (
        F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        for order in (("_t", "_side"), (F.desc("_t"), F.desc("_side")))
    )
    met = both.withColumn("_b", back).withColumn("_a", ahead).where("_side = 1")
    pick = F.when(F.col("_a").isNull() | (F.col("_t") - F.col("_b.t") <= F.col("_a.t") - F.col("_t")), F.col("_b")).otherwise(F.col("_a"))
    met = met.withColumn("_p", pick)
    return met.select("_row.*", F.col("_p.t").alias(f"matched_{time}"), *[F.col(f"_p.{v}").alias(f"matched_{v}") for v in values])


def resample(samples: DataFrame, columns: list[str], step: float, time: str = "t", key: str = "session_id") -> DataFrame:
    """Linear interpolation onto a grid of `step` from each session's first to its last sample: key, g, t, columns.

    Each sample covers the grid points up to the next one, so the grid comes from its bracket and no join is needed.
    """
    w = Window.partitionBy(key).orderBy(time)
    span = samples.withColumn("_start", F.min(time).over(Window.partitionBy(key))).withColumn("_next", F.lead(time).over(w))
    for c in columns:
        span = span.withColumn(f"_n_{c}", F.lead(c).over(w))
    low = F.ceil((F.col(time) - F.col("_start")) / step - 1e-9)
    high = F.when(F.col("_next").isNull(), F.floor((F.col(time) - F.col("_start")) / step + 1e-9)).otherwise(
        F.ceil((F.col("_next") - F.col("_start")) / step - 1e-9) - 1
    )
    points = span.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")).where("_low <= _high")
    points = points.withColumn("g", F.explode(F.sequence("_low", "_high")))
    share = F.when(F.col("_next").isNull() | (F.col("_next") <= F.col(time)), 0.0).otherwise(
        (F.col("_start") + F.col("g") * step - F.col(time)) / (F.col("_next") - F.col(time))
    )
    points = points.withColumn("_share", share)
    values = [(F.col(c) + F.col("_share") * (F.coalesce(F.col(f"_n_{c}"), F.col(c)) - F.col(c))).alias(c) for c in columns]
    return points.select(key, "g", (F.col("_start") + F.col("g") * step).alias("t"), *values)


def hop_windows(events: DataFrame, time: str, size: str, hop: str, *aggregates: Column, keys: list[str] = (), late: str | None = None) -> DataFrame:
    """Event-time windows; on a stream, `late` is the watermark's delay."""
    rows = events.withWatermark(time, late) if late else events
    found = rows.groupBy(*keys, F.window(time, size, hop).alias("_w")).agg(*aggregates)
    return found.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in found.columns if c not in (*keys, "_w")])
