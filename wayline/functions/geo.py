"""Geodesy and plane geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres, metres per second squared.
EARTH_RADIUS_M = 6371000.0
GRAVITY = 9.80665


def kmh_to_ms(speed: Column) -> Column:
    return speed / 3.6


def wrap_radians(angle: Column) -> Column:
    """To [0, 2 pi)."""
    return F.pmod(angle, F.lit(2) * F.pi())


def wrap_degrees(angle: Column) -> Column:
    """To [0, 360)."""
    return F.pmod(angle, F.lit(360.0))


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, arcsine form."""
    return F.asin(F.least(F.lit(1.0), F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))) * (2 * EARTH_RADIUS_M)


def haversine_atan2_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, two-argument arctangent form (routes use it)."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a))) * (2 * EARTH_RADIUS_M)


def east_m(lon: Column, ref_lat: Column, ref_lon: Column) -> Column:
    return F.radians(lon - ref_lon) * EARTH_RADIUS_M * F.cos(F.radians(ref_lat))


def north_m(lat: Column, ref_lat: Column) -> Column:
    return F.radians(lat - ref_lat) * EARTH_RADIUS_M


def enu_to_lat(north: Column, ref_lat: Column) -> Column:
    return ref_lat + F.degrees(north / EARTH_RADIUS_M)


def enu_to_lon(east: Column, ref_lat: Column, ref_lon: Column) -> Column:
    return ref_lon + F.degrees(east / (F.cos(F.radians(ref_lat)) * EARTH_RADIUS_M))


def segment_share(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Where on the segment a-b, from 0 to 1, the point nearest p lies; 0 on a segment of no length."""
    (px, py), (ax, ay), (bx, by) = p, a, b
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = ((px - ax) * dx + (py - ay) * dy) / square
    return F.when(square < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))


def segment_heading_deg(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Bearing of a-b, clockwise from north, in [0, 360)."""
    return wrap_degrees(F.degrees(F.atan2(b[0] - a[0], b[1] - a[1])))


def heading_difference_deg(h1: Column, h2: Column) -> Column:
    """Angle between two headings of a two-way road, in [0, 90]."""
    around = F.pmod(F.abs(h1 - h2), F.lit(360.0))
    turn = F.least(around, 360 - around)
    return F.least(turn, 180 - turn)
