"""Channel statistics, splits by session, model scores and comparisons."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.prefix import running_totals


def channel_stats(rows: DataFrame, channels: list[str], keys: list[str] = ()) -> DataFrame:
    """channel, mean, std: population deviation, 1 where it is 0. One aggregate over all channels, then unpivoted."""
    aggregates = [a for c in channels for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    wide = rows.groupBy(*keys).agg(*aggregates) if keys else rows.agg(*aggregates)
    guard = lambda c: F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std"))
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_mean").alias("mean"), guard(c).alias("std")) for c in channels])
    return wide.select(*keys, F.inline(each))


def window_channel_stats(windows: DataFrame, channels: list[str]) -> DataFrame:
    """As `channel_stats` over all samples of all windows; a sample counts once for each window that has it."""
    rows = windows.select(F.explode("imu").alias("_r")).select(*[F.col("_r")[i].alias(c) for i, c in enumerate(channels)])
    return channel_stats(rows, channels)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def denormalised(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def split_of(session_ids: list[str], val_fraction: float = 0.1, test_fraction: float = 0.1, seed: int = 42) -> dict[str, list[str]]:
    """Sessions by part, each in exactly one: a seeded shuffle of the sorted ids, cut into train, validation and test.

    Runs on the distinct ids only (one string per recording). Shares are rounded half to even and at least one session;
    two sessions make train and validation, one makes train.
    """
    ids = sorted(set(session_ids))
    random.Random(seed).shuffle(ids)
    n = len(ids)
    val = max(1, round(n * val_fraction)) if n > 2 else int(n == 2)
    test = max(1, round(n * test_fraction)) if n > 2 else 0
    train = n - val - test
    if n > 2 and train <= 0:
        train, val = 1, max(1, (n - 1) // 2)
    return {"train": sorted(ids[:train]), "val": sorted(ids[train : train + val]), "test": sorted(ids[train + val :])}


def session_splits(rows: DataFrame, **options) -> DataFrame:
    """session_id, split, by `split_of`. The distinct sessions come to the driver, one id per recording; beyond some millions
    of them use `hash_splits`."""
    ids = [r["session_id"] for r in rows.select("session_id").distinct().toLocalIterator()]
    pairs = [(s, part) for part, members in split_of(ids, **options).items() for s in members]
    return rows.sparkSession.createDataFrame(pairs, "session_id string, split string")


def hash_splits(rows: DataFrame, val_fraction: float = 0.1, test_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """session_id, split, for any number of sessions: `split_of`'s shares over the sessions in the order of their seeded md5.

    The order is numbered by range partitions and prefix sums, so no task and not the driver sees all sessions.
    """
    ids = rows.select("session_id").distinct().withColumn("_one", F.lit(1))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("session_id").cast("string")))
    placed = running_totals(ids, [key, F.col("session_id")], "_one")
    n = placed.agg(F.max("_row")).first()[0]
    n = 0 if n is None else n + 1
    val = max(1, round(n * val_fraction)) if n > 2 else int(n == 2)
    test = max(1, round(n * test_fraction)) if n > 2 else 0
    train = n - val - test
    if n > 2 and train <= 0:
        train, val = 1, max(1, (n - 1) // 2)
    part = F.when(F.col("_row") < train, "train").when(F.col("_row") < train + val, "val").otherwise("test")
    return placed.select("session_id", part.alias("split"))


def partition_stats(rows: DataFrame, speed: str, keys: list[str]) -> DataFrame:
    """Windows and mean, deviation, least and most of a speed, in m/s and km/h."""
    figures = {"mean": F.avg(speed), "std": F.stddev_pop(speed), "min": F.min(speed), "max": F.max(speed)}
    ms = [c.alias(f"{n}_ms") for n, c in figures.items()]
    kmh = [(c * 3.6).alias(f"{n}_kmh") for n, c in figures.items()]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ms, *kmh)


def speed_scores(rows: DataFrame, predicted: str, true: str, keys: list[str] = ()) -> DataFrame:
    """Mean absolute error in m/s and km/h, and smooth L1 loss."""
    gap = F.abs(F.col(predicted) - F.col(true))
    loss = F.avg(F.when(gap < 1, 0.5 * gap * gap).otherwise(gap - 0.5))
    return rows.groupBy(*keys).agg(F.avg(gap).alias("mae_ms"), (F.avg(gap) * 3.6).alias("mae_kmh"), loss.alias("smooth_l1"))


def angle_scores(rows: DataFrame, angle: str, loss: str, keys: list[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg(angle).alias("mean_deg"), F.median(angle).alias("median_deg"), F.percentile(angle, 0.9).alias("p90_deg"), F.avg(loss).alias("cosine_loss")
    )


def parity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Largest and mean absolute difference of two columns."""
    return rows.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs_diff"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"))


def unpivoted(summary: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return summary.unpivot(keys, metrics, "metric", "value")


def compared(versions: dict[str, DataFrame], keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric with a column for each version; what a version lacks is null."""
    found = None
    for name, df in versions.items():
        rows = unpivoted(df, keys, metrics).withColumnRenamed("value", name)
        found = rows if found is None else found.join(rows, [*keys, "metric"], "full_outer")
    return found


def improvement(rows: DataFrame, base: str, other: str) -> DataFrame:
    """Absolute (3 places) and percent (2 places) gain of `other` over `base`; no percent of a base of 0."""
    gain = F.col(base) - F.col(other)
    percent = F.when(F.col(base) != 0, F.round(gain / F.col(base) * 100, 2))
    return rows.withColumn("absolute_improvement", F.round(gain, 3)).withColumn("percent_improvement", percent)
