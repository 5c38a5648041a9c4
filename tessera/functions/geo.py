"""Distances, travel times and location keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, units, speeds and penalties that results must share.
EARTH_M = 6371000.0
METRES_PER_MILE = 1609.344
WALK_M_PER_S, DETOUR_WALK = 1.4, 1.2
DRIVE_KM_PER_H, DRIVE_LEAST_MIN = 30.0, 2
NETWORK_FACTOR, NETWORK_M_PER_S = 1.3, 1.33
METRO_WAIT_MIN, BUS_WAIT_MIN, WALK_WEIGHT, WAIT_WEIGHT = 3.0, 10.0, 1.5, 1.2
LAT_RANGE, LON_RANGE = (37.5, 40.0), (-78.5, -76.0)


def half_up(c: Column) -> Column:
    """Rounded to the nearest whole number, halves up."""
    return F.floor(c + F.lit(0.5))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres over the great circle; the argument of asin is kept at 1 or less."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000


def miles(metres: Column) -> Column:
    return metres / METRES_PER_MILE


def walk_minutes(metres: Column) -> Column:
    return half_up(metres / (WALK_M_PER_S / DETOUR_WALK) / 60)


def drive_minutes(metres: Column) -> Column:
    return F.greatest(F.lit(DRIVE_LEAST_MIN).cast("long"), half_up(metres / 1000 / DRIVE_KM_PER_H * 60))


def network_metres(haversine: Column, routed: Column | None = None) -> Column:
    """The routed distance where one is known, else an estimate from the great circle."""
    estimate = haversine * NETWORK_FACTOR
    return estimate if routed is None else F.coalesce(routed, estimate)


def network_walk_minutes(metres: Column) -> Column:
    return F.round(metres / NETWORK_M_PER_S / 60, 1)


def transit_minutes(stop_walk_minutes: Column, stop_metres: Column, total_metres: Column) -> Column:
    """Walk to the stop, then ride; null without a stop."""
    return F.coalesce(stop_walk_minutes, half_up(stop_metres / 80)) + half_up(miles(total_metres) / 15 * 60)


def travel_cost(walk_min: Column, wait_min: float) -> Column:
    return walk_min * WALK_WEIGHT + F.lit(wait_min) * WAIT_WEIGHT


def transit_mode(metro_walk_min: Column, bus_walk_min: Column) -> Column:
    """``metro`` or ``bus``, whichever costs less (metro on a tie); null if there is neither."""
    metro, bus = travel_cost(metro_walk_min, METRO_WAIT_MIN), travel_cost(bus_walk_min, BUS_WAIT_MIN)
    return F.when(metro_walk_min.isNotNull() & (bus_walk_min.isNull() | (metro <= bus)), "metro").when(bus_walk_min.isNotNull(), "bus")


def in_region(lat: Column, lon: Column) -> Column:
    return lat.between(*LAT_RANGE) & lon.between(*LON_RANGE)


def cell_key(lat: Column, lon: Column, places: int) -> Column:
    """``lat_lon`` with so many decimal places: the key of caches by location."""
    return F.concat_ws("_", *[F.format_string(f"%.{places}f", half_up(c * 10**places) / 10**places) for c in (lat, lon)])
