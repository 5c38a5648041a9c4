"""Ranking of places for a person: factor scores, weighted sums, facets and orders."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo

# The weights of (proximity, timing, ease, trust, language, tone, service) for each mode.
WEIGHTS = {
    "preference": (0.20, 0.20, 0.05, 0.10, 0.05, 0.05, 0.35),
    "closest": (0.30, 0.25, 0.10, 0.15, 0.10, 0.10, 0.0),
    "most_private": (0.15, 0.15, 0.30, 0.10, 0.10, 0.20, 0.0),
    "most_welcoming": (0.20, 0.15, 0.25, 0.10, 0.10, 0.20, 0.0),
}
FRICTION = {"appointment_required": 0.35, "photo_id": 0.2, "proof_of_address": 0.15, "income_verification": 0.2}
TIMING = {"open": 1.0, "opens_today": 0.85, "opens_this_week": 0.5}
FACTORS = ["proximity", "timing", "ease", "trust", "language", "tone", "service"]


@dataclass
class Person:
    """Who asks: where they are, what they speak and what they look for."""

    lat: float
    lon: float
    mode: str = "closest"
    languages: list[str] = field(default_factory=lambda: ["en"])
    services: list[str] = field(default_factory=list)
    limit: int = 30


def reliability(n_sources: Column, has_hours: Column, has_phone: Column, has_website: Column) -> Column:
    """``struct<tier, score>``; the tier goes by the score before it is rounded. Hundredths are summed as whole numbers."""
    hundredths = F.lit(80) + F.when(n_sources >= 3, 15).when(n_sources >= 2, 10).otherwise(0) + F.when(has_hours, 5).otherwise(0) + F.when(has_phone & has_website, 5).otherwise(0)
    capped = F.least(F.lit(100), hundredths)
    tier = F.when(capped >= 90, "fresh").when(capped >= 70, "recent").when(capped >= 40, "stale").otherwise("unknown")
    return F.struct(tier.alias("tier"), (capped / 100).alias("score"))


def factors(places: DataFrame, person: Person) -> DataFrame:
    """The places with ``distance_m``, travel minutes and a column for each factor. Places without coordinates go.

    Needs place_lat, place_lon, state, requirements, languages, services, trust, tone.
    """
    out = places.where(F.col("place_lat").isNotNull() & F.col("place_lon").isNotNull() & ~F.isnan("place_lat") & ~F.isnan("place_lon"))
    out = out.withColumn("distance_m", geo.haversine_m(F.lit(person.lat), F.lit(person.lon), F.col("place_lat"), F.col("place_lon")))
    friction = sum((F.when(F.array_contains("requirements", r), F.lit(w)).otherwise(0.0) for r, w in FRICTION.items()), F.lit(0.0))
    timing = F
    for state, value in TIMING.items():
        timing = timing.when(F.col("state") == state, value)
    service = F.lit(1.0) if not person.services else F.when(F.coalesce(F.arrays_overlap("services", F.array(*map(F.lit, person.services))), F.lit(False)), 1.0).otherwise(0.15)
    return out.withColumns(
        {
            "walk_min": geo.walk_minutes(F.col("distance_m")),
            "drive_min": geo.drive_minutes(F.col("distance_m")),
            "proximity": F.greatest(F.lit(0.0), 1 - geo.miles(F.col("distance_m")) / 8),
            "timing": timing.otherwise(0.2),
            "ease": 1 - F.least(friction, F.lit(1.0)),
            "trust": F.col("trust").cast("double"),
            "language": F.when(F.coalesce(F.arrays_overlap("languages", F.array(*map(F.lit, person.languages))), F.lit(False)), 1.0).otherwise(0.5),
            "tone": F.col("tone").cast("double"),
            "service": service,
        }
    )


def rank(places: DataFrame, person: Person, places_of_score: int = 6) -> DataFrame:
    """The best places with their ``score``, best first; equal scores in order of ``place``."""
    weights = WEIGHTS["preference" if person.services else person.mode]
    score = sum((F.col(f) * F.lit(w) for f, w in zip(FACTORS, weights, strict=True)), F.lit(0.0))
    found = factors(places, person).withColumn("score", F.round(score, places_of_score))
    return found.orderBy(F.desc("score"), "place").limit(person.limit)


def breakdown(ranked: DataFrame) -> DataFrame:
    """A row for each factor of each ranked place."""
    return ranked.unpivot(["place"], FACTORS, "factor", "value")


def open_tier(state: Column) -> Column:
    return F.when(state == "open", 0).when(state == "opens_today", 1).when(state == "opens_this_week", 2).otherwise(3)


def by_tier_and_distance(places: DataFrame, limit: int = 30) -> DataFrame:
    return places.orderBy(open_tier(F.col("state")), "distance_m", "place").limit(limit)


FACETS = {
    "open": lambda: F.col("state") == "open",
    "today": lambda: F.col("state").isin("open", "opens_today"),
    "walk": lambda: F.col("walk_min") <= 20,
    "metro": lambda: F.col("transit_kind") == "metro",
    "es": lambda: F.array_contains("languages", "es"),
    "am": lambda: F.array_contains("languages", "am"),
    "no_id": lambda: F.array_contains("requirements", "no_id_required") | ~F.array_contains("requirements", "photo_id"),
    "delivers": lambda: F.array_contains("services", "delivery"),
}


def facets(places: DataFrame, *active: str) -> DataFrame:
    """Places that have all the active facets."""
    return places.where(reduce(lambda a, b: a & b, [F.coalesce(FACETS[name](), F.lit(False)) for name in active], F.lit(True)))


def donors(places: DataFrame, max_miles: float | None = None, with_url: bool = False) -> DataFrame:
    """Places that take food or money, the most urgent first, then the nearest."""
    found = places.where(F.col("accepts_food") | F.col("accepts_money"))
    if max_miles is not None:
        found = found.where(geo.miles(F.col("distance_m")) <= max_miles)
    if with_url:
        found = found.where(F.length("donate_url") > 0)
    return found.orderBy(F.when(F.col("urgency") == "high", 0).when(F.col("urgency") == "medium", 1).otherwise(2), "distance_m", "place")


def volunteers(places: DataFrame, max_miles: float | None = None, with_url: bool = False, spanish: bool = False, walk_in: bool = False) -> DataFrame:
    """Places that take volunteers, the nearest first."""
    found = places.where("accepts_volunteers")
    if max_miles is not None:
        found = found.where(geo.miles(F.col("distance_m")) <= max_miles)
    if with_url:
        found = found.where((F.length("volunteer_url") > 0) | (F.length("website") > 0))
    if spanish:
        found = found.where(F.array_contains("languages", "es"))
    if walk_in:
        found = found.where(F.array_contains("requirements", "walk_in"))
    return found.orderBy("distance_m", "place")


def trending(places: DataFrame, limit: int = 4) -> DataFrame:
    """Places open today with coordinates and a description, the most reliable first."""
    known = F.col("place_lat").isNotNull() & (F.length("hero_copy") > 0) & F.col("state").isin("open", "opens_today")
    return places.where(known).orderBy(F.desc("trust"), "place").limit(limit)


def promotable(places: DataFrame) -> DataFrame:
    return places.where(F.col("tier").isin("fresh", "recent"))


def backups(ranked: DataFrame, limit: int = 5) -> DataFrame:
    """What follows the best promotable place, for when it doesn't suit: the first few others."""
    order = Window.orderBy(F.desc("score"), "place")  # over a ranked list of a set length
    chosen = promotable(ranked).withColumn("__n", F.row_number().over(order)).where("__n = 1").select("place")
    return ranked.join(F.broadcast(chosen), "place", "left_anti").orderBy(F.desc("score"), "place").limit(limit)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def cursor(rows: DataFrame, order: list, key: str) -> DataFrame:
    """Each row of a short list with the key before and after it, the ends joined."""
    w = Window.orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("previous", F.coalesce(F.lag(key).over(w), F.last(key).over(whole))).withColumn("next", F.coalesce(F.lead(key).over(w), F.first(key).over(whole)))


def point_lookup(ranked: DataFrame, every: DataFrame, key: str, value) -> DataFrame:
    """The row of a key from the ranked ones, else from all."""
    found = ranked.where(F.col(key) == value).withColumn("__from", F.lit(0)).unionByName(every.where(F.col(key) == value).withColumn("__from", F.lit(1)), allowMissingColumns=True)
    return found.orderBy("__from").limit(1).drop("__from")
