"""Every registered query of the telemetry engine and its DuckDB oracle."""

from __future__ import annotations

from wayline.plans import filter_algebra, filters, geometry, live, outages, recording_path, roads, sequences, streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (outages, sequences, geometry, roads, filters, filter_algebra, streams, live, recording_path):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
