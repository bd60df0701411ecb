"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import blackout as B
from wayline.operators.tracking import track
from wayline.sources.events import raw_steps, true_steps

#: Rows of a chunk in the queries over sessions of any length. Small, so that the tables' sessions have several.
CHUNK_ROWS = 50


def r(x: Column | str, n: int = 6) -> Column:
    """Rounded, with one zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(x) < 5 * 10 ** -(n + 1), 0.0).otherwise(F.round(x, n))


def rounded(df: DataFrame, exact: list[str], places: int = 6, /, **columns: Column | str) -> DataFrame:
    return df.select(*exact, *[r(c, places).alias(name) for name, c in columns.items()])


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.outage_intervals(B.session_lengths(raw_steps(spark, sf_dir)))


def tracked(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    """Points with errors, and the intervals."""
    intervals = event_intervals(spark, sf_dir)
    return track(true_steps(spark, sf_dir), intervals, **options), intervals


def metrics(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    points, intervals = tracked(spark, sf_dir, **options)
    return B.interval_metrics(B.members(points, intervals))
