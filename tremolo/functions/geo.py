"""Distances and travel times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def km_to_degrees(km: Column) -> Column:
    return km / F.lit(EARTH_KM * 3.141592653589793 / 180)


def travel_time(distance: Column, depth: Column | float = 10.0, velocity: float = 6.0) -> Column:
    """Seconds along the straight ray in a half-space."""
    return F.hypot(distance, F.lit(depth) if isinstance(depth, float) else depth) / F.lit(velocity)


def distance_from_delay(delay: Column, vp: float = 6.0, vs: float = 3.5) -> Column:
    """Distance from the delay of the slower wave behind the faster."""
    return delay * F.lit(vp * vs / (vp - vs))


def blind_radius(seconds: Column, depth: float = 10.0, vs: float = 3.5) -> Column:
    """Epicentral distance that the slower wave has reached after some seconds, 0 before it surfaces."""
    reach = F.lit(vs) * seconds
    return F.sqrt(F.greatest(reach * reach - F.lit(depth * depth), F.lit(0.0)))
