"""Dead reckoning: headings and positions as window sums; blended headings as a fold over each session.

Where `chunk` is given, a session is cut into pieces of so many rows, so that none has to fit into a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import EARTH_RADIUS_M
from wayline.operators.scans import lagged, running
from wayline.operators.sequence import spread
from wayline.operators.storage import cut

TWO_PI = 2 * math.pi
#: Weight of a satellite heading in the blend. Fixed value.
BLEND = 0.1
#: About so many rows of whole sessions are folded together.
GROUP_ROWS = 100_000


def with_dt(steps: DataFrame, keys: list[str], fallback: float = 0.1, chunk: int | None = None) -> DataFrame:
    """`dt`: seconds since the step before; `fallback` if that isn't positive; 0 for the first step."""
    if chunk:
        steps = lagged(steps, keys, "i", chunk, {"_t": ("t_s", 1)})
    else:
        steps = steps.withColumn("_t", F.lag("t_s").over(Window.partitionBy(*keys).orderBy("i")))
    gap = F.col("t_s") - F.col("_t")
    return steps.withColumn("dt", F.when(gap.isNull(), 0.0).when(gap <= 0, fallback).otherwise(gap)).drop("_t")


def headings(steps: DataFrame, gyro: str, init_deg: str, keys: list[str], into: str = "heading_rad", chunk: int | None = None) -> DataFrame:
    """Integrated yaw rate (positive turns right) from each session's first heading, in [0, 2 pi)."""
    if chunk:
        rows = running(steps, keys, "i", chunk, {"_turn": F.col(gyro) * F.col("dt")}, {"_first": init_deg})
        return rows.withColumn(into, F.pmod(F.radians("_first") + F.col("_turn"), F.lit(TWO_PI))).drop("_turn", "_first")
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(init_deg).over(w)
    turn = F.sum(F.col(gyro) * F.col("dt")).over(w)
    return steps.withColumn(into, F.pmod(F.radians(first) + turn, F.lit(TWO_PI)))


HeadingRule = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def blended(heading: np.ndarray, gyro: np.ndarray, dt: np.ndarray, fix: np.ndarray) -> np.ndarray:
    """Gyro integration with a tenth of the satellite heading where there is one (NaN or None: none). The blend is linear, not
    circular: of 359 and 1 degrees it makes 323.2."""
    moved, fix = heading + gyro * dt, np.asarray(fix, float)
    return np.where(np.isnan(fix), moved, (1 - BLEND) * moved + BLEND * fix) % TWO_PI


def circular_blended(heading: np.ndarray, gyro: np.ndarray, dt: np.ndarray, fix: np.ndarray) -> np.ndarray:
    """As `blended`, along the shorter arc."""
    moved, fix = heading + gyro * dt, np.asarray(fix, float)
    turn = (fix - moved) - TWO_PI * np.round((fix - moved) / TWO_PI)
    return (moved + np.where(np.isnan(fix), 0.0, BLEND * turn)) % TWO_PI


def in_step(lengths: np.ndarray, first: np.ndarray, rule: HeadingRule, gyro: np.ndarray, dt: np.ndarray, fixes: np.ndarray) -> np.ndarray:
    """Headings of sessions that stand one after another (`lengths` rows each), all moved a step at a time: a step is one
    array operation over the sessions that are that long."""
    starts = np.cumsum(lengths) - lengths
    longest = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[longest], lengths[longest]
    out = np.empty(len(gyro))
    heading = first[starts]
    out[starts] = heading
    for step in range(1, int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step, "left"))  # those longer than `step`
        at = starts[:n] + step
        heading = out[at] = rule(heading[:n], gyro[at], dt[at], fixes[at])
    return out


def folded_headings(steps: DataFrame, gyro: str, init_deg: str, keys: list[str], rule: HeadingRule = blended, into: str = "heading_rad") -> DataFrame:
    """Headings by any rule, step by step: satellite headings (`gt_heading_deg`) count outside outages.

    A true recurrence, over one number per step. Many sessions share a group, whose rows are sorted once and whose sessions
    move in step; a group has about GROUP_ROWS rows, or one session if that is longer.
    """
    schema = steps.withColumn(into, F.lit(0.0)).schema

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_bucket").sort_values([*keys, "i"], ignore_index=True)
        starts = np.flatnonzero(~rows.duplicated(keys).to_numpy())
        fixes = np.radians(rows["gt_heading_deg"].where(~rows["is_blackout"].astype(bool)).to_numpy(float))
        first = np.radians(rows[init_deg].to_numpy(float)) % TWO_PI
        lengths = np.diff(np.append(starts, len(rows)))
        return rows.assign(**{into: in_step(lengths, first, rule, rows[gyro].to_numpy(float), rows["dt"].to_numpy(float), fixes)})

    buckets = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-steps.count() // GROUP_ROWS))
    dealt = steps.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return spread(dealt, ["_bucket"]).groupBy("_bucket").applyInPandas(fold, schema)


def _is_fix(fixed: bool) -> Column:
    return (F.col("i") == 0) | ((~F.col("is_blackout") & F.col("gt_lat").isNotNull() & F.col("gt_lon").isNotNull()) if fixed else F.lit(False))


def positions(steps: DataFrame, speed: str, keys: list[str], fixed: bool = True, chunk: int | None = None) -> DataFrame:
    """lat and lon in degrees along the headings, started at gt_lat and gt_lon and put back there at every fix.

    A step moves along its new heading; its east share is scaled at the latitude before it. Where `fixed`, each step
    outside outages takes the true position instead (its own movement is dropped). The sums start anew at each fix, so
    two window passes over one sort give every position. With `chunk` the rows are checkpointed before each of the two
    sums, as the sums' totals and the sums read them.
    """
    if chunk:
        return _chunked_positions(steps, speed, keys, fixed, chunk)
    w = Window.partitionBy(*keys).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    moved = steps.withColumn("_fix", _is_fix(fixed)).withColumn("_run", F.count(F.when(F.col("_fix"), 1)).over(upto))
    run = Window.partitionBy(*keys, "_run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    metres = F.col(speed) * F.col("dt") / EARTH_RADIUS_M
    moved = moved.withColumn("_north", F.when(F.col("_fix"), 0.0).otherwise(metres * F.cos("heading_rad")))
    moved = moved.withColumn("_lat", F.radians(F.first("gt_lat").over(run)) + F.sum("_north").over(run))
    east = metres * F.sin("heading_rad") / F.cos(F.lag("_lat").over(w))
    moved = moved.withColumn("_east", F.when(F.col("_fix"), 0.0).otherwise(east))
    moved = moved.withColumn("_lon", F.radians(F.first("gt_lon").over(run)) + F.sum("_east").over(run))
    return moved.withColumns({"lat": F.degrees("_lat"), "lon": F.degrees("_lon")}).drop("_fix", "_run", "_north", "_east", "_lat", "_lon")


def _chunked_positions(steps: DataFrame, speed: str, keys: list[str], fixed: bool, chunk: int) -> DataFrame:
    """A step that isn't a fix has its predecessor in its own run, so the latitude before it is its own less its movement."""
    metres = F.col(speed) * F.col("dt") / EARTH_RADIUS_M
    moved = running(steps.withColumn("_fix", _is_fix(fixed)), keys, "i", chunk, {"_run": F.col("_fix").cast("long")})
    moved = cut(moved.withColumn("_north", F.when(F.col("_fix"), 0.0).otherwise(metres * F.cos("heading_rad"))))
    moved = running(moved, keys, "i", chunk, {"_norths": F.col("_north")}, {"_lat": "gt_lat"}, run="_run")
    moved = moved.withColumn("_lat", F.radians("_lat") + F.col("_norths"))
    east = metres * F.sin("heading_rad") / F.cos(F.col("_lat") - F.col("_north"))
    moved = cut(moved.withColumn("_east", F.when(F.col("_fix"), 0.0).otherwise(east)))
    moved = running(moved, keys, "i", chunk, {"_easts": F.col("_east")}, {"_lon": "gt_lon"}, run="_run")
    moved = moved.withColumns({"lat": F.degrees("_lat"), "lon": F.degrees(F.radians("_lon") + F.col("_easts"))})
    return moved.drop("_fix", "_run", "_north", "_norths", "_east", "_easts", "_lat", "_lon")
