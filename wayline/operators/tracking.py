"""Outage evaluation by dead reckoning: steps to trajectories, errors and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wayline.operators import blackout as B
from wayline.operators.deadreckon import HeadingRule, blended, folded_headings, headings, positions

VARIANT = ["session_id", "duration_s"]


def track(steps: DataFrame, intervals: DataFrame, blend: bool = False, rule: HeadingRule = blended, chunk: int | None = None) -> DataFrame:
    """Estimated positions of every session under every outage schedule, with errors against the truth.

    Without `blend` headings come from the gyro alone and the whole plan is native; with it, satellite headings outside
    outages are blended in by `rule`. With `chunk` no session has to fit into a task, but for a blend, which is a recurrence.
    """
    rows = B.in_outage(steps, intervals)
    if blend:
        rows = folded_headings(rows, "gyro_z", "gt_heading_deg", VARIANT, rule)
    else:
        rows = headings(rows, "gyro_z", "gt_heading_deg", VARIANT, chunk=chunk)
    return B.position_errors(positions(rows, "speed_ms", VARIANT, chunk=chunk))


def evaluate(steps: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """Metrics of each interval."""
    return B.interval_metrics(B.members(track(steps, intervals, **options), intervals))
