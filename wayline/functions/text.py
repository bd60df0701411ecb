"""Shown texts: distances, durations, progress, rejection reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_text(metres: Column) -> Column:
    return F.when(metres >= 1000, F.format_string("%.1f km", metres / 1000.0)).otherwise(F.format_string("%d m", metres.cast("long")))


def duration_text(seconds: Column) -> Column:
    minutes = (seconds / 60).cast("long")
    hours = F.floor(minutes / 60)
    return F.when(hours > 0, F.format_string("%dh %dm", hours, minutes % 60)).otherwise(F.format_string("%d mins", minutes))


def progress_text(percent: Column, remaining: Column) -> Column:
    return F.format_string("Progress: %d%% (Rem: %s)", percent, remaining)


def rejection_text(outcome: Column, distance: Column, turn: Column, max_distance: float, max_turn: float) -> Column:
    """The reason in words of an outcome: no_road, distance, heading or matched."""
    far = F.format_string("distance %.1fm exceeds max_match_dist_m (%.1fm)", distance, F.lit(float(max_distance)))
    off = F.format_string("heading diff %.1fdeg exceeds max_heading_diff_deg (%.1fdeg)", turn, F.lit(float(max_turn)))
    return F.when(outcome == "no_road", "no road polyline provided").when(outcome == "distance", far).when(outcome == "heading", off).otherwise("")
