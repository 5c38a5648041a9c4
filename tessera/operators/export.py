"""The exported shape of a record: nested blocks, names for the front end, and summaries in words."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.blank import blank_to_null, has_number, has_text
from tessera.functions.text import canonical_state, coded, services_of
from tessera.operators.equity import urgency

LANGUAGE_CODES = {"english": "en", "spanish": "es", "amharic": "am", "french": "fr", "arabic": "ar", "chinese": "zh", "korean": "ko", "vietnamese": "vi", "portuguese": "pt"}
SERVICE_ALIASES = {"pantry": "food_pantry", "meals": "hot_meals"}
NOT_SERVICES = ["walk_in", "appointment_required", "no_id_required", "photo_id", "proof_of_address", "income_verification"]


def essential(records: DataFrame) -> DataFrame:
    """Rows with a name, an address and a location; 0 is no location."""
    return records.where(has_text(F.col("name")) & has_text(F.col("address")) & has_number(F.col("lat")) & has_number(F.col("lon")))


def transit_summary(metro: Column, bus: Column) -> Column:
    """``metro``: struct name, lines, walk_minutes. ``bus``: struct route, walk_minutes. Either may be null."""
    return F.coalesce(
        blank_to_null(
            F.concat_ws(
                "; ",
                F.when(metro.isNotNull(), F.concat(metro["walk_minutes"].cast("string"), F.lit("-min walk to "), metro["name"], F.lit(" ("), F.array_join(metro["lines"], "/"), F.lit(" line)"))),
                F.when(bus.isNotNull(), F.concat(bus["walk_minutes"].cast("string"), F.lit("-min walk to Route "), bus["route"], F.lit(" bus"))),
            )
        ),
        F.lit("No transit nearby"),
    )


def transit_block(metro: Column, bus: Column, chosen: Column) -> Column:
    """The nested transit block; null if there is neither stop."""
    directions = F.struct(
        F.when(metro.isNotNull(), F.concat(F.lit("Take the "), F.array_join(metro["lines"], "/"), F.lit(" line to "), metro["name"])).alias("metro"),
        F.when(bus.isNotNull(), F.concat(F.lit("Take bus "), bus["route"])).alias("bus"),
        F.coalesce(chosen, F.when(metro.isNotNull(), "metro").otherwise("bus")).alias("recommended"),
    )
    whole = F.struct(metro.alias("nearestMetro"), bus.alias("nearestBus"), metro["walk_minutes"].alias("walkMinutesToMetro"), bus["walk_minutes"].alias("walkMinutesToBus"), transit_summary(metro, bus).alias("transitSummary"), directions.alias("transitDirections"))
    return F.when(metro.isNotNull() | bus.isNotNull(), whole)


def nearest_stop(metro: Column, bus: Column, kind: Column) -> Column:
    """``struct<name, distanceMeters, walkMinutes>`` of the chosen kind."""
    name = F.when(kind == "metro", metro["name"]).when(kind == "bus", bus["route"])
    walk = F.when(kind == "metro", metro["walk_minutes"]).when(kind == "bus", bus["walk_minutes"])
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(F.when(kind == "metro", metro["metres"]).otherwise(bus["metres"]), F.lit(0.0)).alias("distanceMeters"), walk.alias("walkMinutes")))


def weather_block(alert: Column) -> Column:
    return F.when(alert.isNotNull(), F.struct(alert["event"].alias("event"), alert["severity"].alias("severity"), alert["level"].alias("alertLevel"), alert["affects_travel"].alias("affectsTravel")))


def plain_copy(text: Column, says_nothing: list[str]) -> Column:
    """Copy, or null where it says nothing."""
    kept = F.trim(text)
    return F.when(~(F.lower(kept).isin([s.lower() for s in says_nothing]) | F.startswith(F.lower(kept), F.lit("nourishing"))), kept)


def exported(records: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The export: front-end names, codes for languages, canonical services and state, nested blocks; nothing internal.

    Needs id, name, address, zip, state, lat, lon, phone, website, hours, services, requirements, languages, hero_copy,
    guide, eligibility, tone, trust, tier, metro, bus, mode, alert. Columns named in ``more`` are kept as they are.
    """
    return essential(records).select(
        "id",
        "name",
        "address",
        "zip",
        canonical_state(F.col("state")).alias("state"),
        "lat",
        "lon",
        "phone",
        "website",
        F.col("hours").alias("hoursRaw"),
        services_of(F.col("services"), SERVICE_ALIASES, NOT_SERVICES).alias("services"),
        F.col("requirements").alias("accessRequirements"),
        coded(F.col("languages"), LANGUAGE_CODES).alias("languages"),
        F.struct(plain_copy(F.col("hero_copy"), ["N/A", ""]).alias("heroCopy"), F.col("guide").alias("firstVisitGuide"), F.coalesce("eligibility", F.lit("")).alias("plainEligibility"), F.coalesce("tone", F.lit(0.6)).alias("toneScore"), F.col("trust").alias("qualityScore")).alias("ai"),
        F.struct("tier", F.col("trust").alias("score")).alias("reliability"),
        nearest_stop(F.col("metro"), F.col("bus"), F.col("mode")).alias("nearestTransit"),
        transit_block(F.col("metro"), F.col("bus"), F.col("mode")).alias("transit"),
        weather_block(F.col("alert")).alias("weather"),
        *more,
    )


# The names that sources are shown by, and the states that are counted by name.
SOURCE_NAMES = {"cafb": "Capital Area Food Bank", "mdfb-find-food": "Maryland Food Bank", "two11md": "211 Maryland", "two11va": "211 Virginia", "mocofood": "Montgomery County Food Council"}
STATES = ["MD", "VA", "DC"]


def whole(records: DataFrame, areas: DataFrame, now: Column) -> DataFrame:
    """``exported`` with every field of the published file: place, food, flat transit fields, provenance, giving, urgency, times.

    ``records`` also needs city, food_types, source, source_ids, accepts_food, accepts_money, accepts_volunteers,
    donate_url, volunteer_url. ``areas`` has a row for each zip: zip, neighborhood, gap; a zip without one has neither
    neighborhood nor urgency.
    """
    rows = records.join(areas.select("zip", "neighborhood", "gap"), "zip", "left")
    metro, bus, mode, alert = (F.col(c) for c in ("metro", "bus", "mode", "alert"))
    ids = F.when(F.size("source_ids") > 0, F.col("source_ids")).otherwise(F.array(F.coalesce("source", F.lit("unknown"))))
    named = F.create_map(*[F.lit(x) for pair in SOURCE_NAMES.items() for x in pair])
    source = F.coalesce("source", F.lit("unknown"))
    signal = urgency(F.col("gap"))
    more = {
        "neighborhood": F.col("neighborhood"),
        "city": F.coalesce("city", F.lit("")),
        "foodTypes": F.coalesce("food_types", F.array().cast("array<string>")),
        "nearestTransitType": mode,
        "nearestTransitLines": F.when(mode == "metro", metro["lines"]).when(mode == "bus", F.array(bus["route"])),
        "transitDistanceMeters": F.when(mode == "metro", metro["metres"]).when(mode == "bus", bus["metres"]),
        "weatherAlert": weather_block(alert),
        "sourceId": source,
        "sourceName": F.coalesce(F.try_element_at(named, source), source),
        "sourceIds": ids,
        "crossSourceCount": F.size(ids),
        "acceptsFoodDonations": F.coalesce("accepts_food", F.lit(False)),
        "acceptsMoneyDonations": F.coalesce("accepts_money", F.lit(False)),
        "acceptsVolunteers": F.coalesce("accepts_volunteers", F.lit(False)),
        "donateUrl": F.col("donate_url"),
        "volunteerUrl": F.col("volunteer_url"),
        "urgency": F.when(signal["level"].isNotNull(), signal),
        "createdAt": now,
        "updatedAt": now,
    }
    own = {f"__{name}": column for name, column in more.items()}
    return exported(rows.withColumns(own), list(own)).drop("weather").withColumnsRenamed({f"__{name}": name for name in more})


def coverage() -> dict[str, Column]:
    """What the metadata counts of exported rows: fields that say something, records by state and by source."""
    has = {
        "hours": has_text(F.col("hoursRaw")),
        "coords": has_number(F.col("lat")) & has_number(F.col("lon")),
        "heroCopy": has_text(F.col("ai.heroCopy")),
        "website": has_text(F.col("website")),
        "foodTypes": F.size("foodTypes") > 0,
        "languages": F.size("languages") > 0,
        "transit": F.col("transit").isNotNull(),
        "metro": F.col("transit.nearestMetro").isNotNull(),
        "bus": F.col("transit.nearestBus").isNotNull(),
        "weatherAlerts": F.col("weatherAlert").isNotNull(),
    }
    named = {f"coverage.{name}": held for name, held in has.items()}
    named |= {f"byState.{s}": F.col("state") == s for s in STATES} | {"byState.other": ~F.coalesce(F.col("state").isin(STATES), F.lit(False))}
    return named | {f"bySource.{s}": F.col("sourceId") == s for s in SOURCE_NAMES} | {"bySource.other": ~F.col("sourceId").isin(list(SOURCE_NAMES))}


def write_export(rows: DataFrame, path: str) -> None:
    """``whole`` rows as JSON lines in ``path/records``, and their metadata as one line in ``path/metadata``.

    The counts are observed by the write itself, so rows and metadata are of one pass. The metadata is written last:
    where it stands, the records are whole. A record's internal fields never get here.
    """
    observed = Observation()
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in coverage().items()]
    rows.observe(observed, F.count("*").alias("totalOrganizations"), *counts).write.mode("overwrite").json(f"{path}/records")
    told = observed.get
    groups = {g: {n.partition(".")[2]: k for n, k in told.items() if n.startswith(f"{g}.")} for g in ("byState", "bySource", "coverage")}
    row = (told["totalOrganizations"], *groups.values())
    metadata = rows.sparkSession.createDataFrame([row], METADATA).withColumn("generatedAt", F.current_timestamp())
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


METADATA = "totalOrganizations long, byState map<string, long>, bySource map<string, long>, coverage map<string, long>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``kind, name, n`` of an export's metadata."""
    told = spark.read.schema(METADATA).json(f"{path}/metadata")
    parts = [told.select(F.lit("total").alias("kind"), F.lit("organizations").alias("name"), F.col("totalOrganizations").alias("n"))]
    parts += [told.select(F.lit(g).alias("kind"), F.explode(g).alias("name", "n")) for g in ("byState", "bySource", "coverage")]
    return reduce(DataFrame.union, parts)


def share_text(name: Column, address: Column, phone: Column, hours: Column) -> Column:
    """What a person sends on: the lines that there are."""
    return F.concat_ws("\n", *[blank_to_null(c) for c in (name, address, phone, hours)])
