"""Completeness, coverage, quality and event reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hours import iso

# Ranks of alerts.
SEVERITY = {"Extreme": 4, "Severe": 3, "Moderate": 2, "Minor": 1}
LEVEL = {"warning": 3, "watch": 2, "advisory": 1, "statement": 0}


def filled(rows: DataFrame, fields: list[str]) -> list[Column]:
    kinds = dict(rows.dtypes)
    return [F.count_if(F.coalesce((F.size(f) if kinds[f].startswith("array") else F.length(F.col(f).cast("string"))) > 0, F.lit(False))).alias(f) for f in fields]


def completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``field, n_filled, percent`` of each field, in one pass."""
    counts = rows.agg(F.count("*").alias("__n"), *filled(rows, fields))
    return counts.unpivot("__n", fields, "field", "n_filled").select("field", "n_filled", F.round(F.col("n_filled") * 100 / F.col("__n"), 0).alias("percent"))


def by_source(rows: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """Records and filled fields of each source, the largest first."""
    return rows.groupBy(source).agg(F.count("*").alias("n_records"), *[c.alias(f"n_{f}") for c, f in zip(filled(rows, fields), fields, strict=True)]).orderBy(F.desc("n_records"), source)


def several_sources(merged: DataFrame) -> DataFrame:
    """One row: merged records, those that several sources tell of, and their per cent."""
    several = F.count_if(F.col("cross_source_count") > 1)
    return merged.agg(F.count("*").alias("records"), several.alias("several_sources"), F.round(100.0 * several / F.count("*"), 1).alias("percent"))


def metadata(rows: DataFrame, groups: list[str], fields: list[str]) -> DataFrame:
    """``kind, name, n, percent``: rows in all, in each value of ``groups`` (null: ``unknown``), and with each field filled."""
    kinds = dict(rows.dtypes)
    has = [(F.size(f) if kinds[f].startswith("array") else F.length(F.col(f).cast("string"))) > 0 for f in fields]
    # A row tells its groups and filled fields at once, so one pass and one partial aggregate count them all.
    told = [F.struct(F.lit("total").alias("kind"), F.lit("records").alias("name"))]
    told += [F.struct(F.lit(g).alias("kind"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("name")) for g in groups]
    told += [F.when(h, F.struct(F.lit("field").alias("kind"), F.lit(f).alias("name"))) for f, h in zip(fields, has, strict=True)]
    counts = rows.select(F.explode(F.array_compact(F.array(*told))).alias("t")).groupBy("t.kind", "t.name").agg(F.count("*").alias("n"))
    every = [("total", "records"), *[("field", f) for f in fields]]
    named = rows.sparkSession.createDataFrame(every, "kind string, name string").join(counts, ["kind", "name"], "left").select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"))
    listed = named.unionByName(counts.where(~F.col("kind").isin("total", "field")))
    total = rows.agg(F.count("*").alias("all"))  # one row
    return listed.join(F.broadcast(total)).select("kind", "name", "n", F.when(F.col("kind") == "field", F.round(100.0 * F.col("n") / F.col("all"), 1)).alias("percent"))


def quality_change(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """``field, before, after, change``."""
    a, b = completeness(before, fields), completeness(after, fields)
    return a.select("field", F.col("n_filled").alias("before")).join(b.select("field", F.col("n_filled").alias("after")), "field").withColumn("change", F.col("after") - F.col("before"))


def changed(rows: DataFrame, old_new: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``field, n_changed``: rows whose new value isn't the old one, nulls told apart from values."""
    return rows.agg(*[F.count_if(~a.eqNullSafe(b)).alias(f) for f, (a, b) in old_new.items()]).unpivot([], list(old_new), "field", "n_changed")


def tag_counts(rows: DataFrame, tags: str) -> DataFrame:
    """How many rows have each tag, the most frequent first."""
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


# Events that are shown, their level, and whether they affect travel.
RELEVANT_ALERTS = [
    ("Tornado Warning", "warning", True),
    ("Tornado Watch", "watch", True),
    ("Flash Flood Warning", "warning", True),
    ("Flash Flood Watch", "watch", True),
    ("Flood Warning", "warning", True),
    ("Flood Watch", "watch", False),
    ("Severe Thunderstorm Warning", "warning", True),
    ("Severe Thunderstorm Watch", "watch", True),
    ("Winter Storm Warning", "warning", True),
    ("Winter Storm Watch", "watch", True),
    ("Blizzard Warning", "warning", True),
    ("Ice Storm Warning", "warning", True),
    ("Freezing Rain Advisory", "advisory", True),
    ("Wind Chill Warning", "warning", True),
    ("Wind Chill Advisory", "advisory", False),
    ("Extreme Cold Warning", "warning", True),
    ("Extreme Cold Watch", "watch", False),
    ("Heat Advisory", "advisory", False),
    ("Excessive Heat Warning", "warning", True),
    ("Excessive Heat Watch", "watch", False),
    ("Dense Fog Advisory", "advisory", True),
    ("High Wind Warning", "warning", True),
    ("High Wind Watch", "watch", True),
    ("Wind Advisory", "advisory", False),
    ("Tropical Storm Warning", "warning", True),
    ("Hurricane Warning", "warning", True),
    ("Hurricane Watch", "watch", True),
    ("Special Weather Statement", "statement", False),
    ("Air Quality Alert", "advisory", False),
]


#: What an alert says of itself.
ALERT_TEXTS = ["headline", "description", "instruction", "onset", "expires"]


def relevant_alerts(spark: SparkSession) -> DataFrame:
    """``event, level, affects_travel`` of the events that are shown."""
    return spark.createDataFrame(RELEVANT_ALERTS, "event string, level string, affects_travel boolean")


def worst_alert(alerts: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """The gravest alert of each key: by severity, then level; the first of equals. ``relevant``: event, level, affects_travel.

    What else the alerts tell (headline, description, instruction, how long they hold) is kept of the gravest one.
    """
    severity = F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])
    level = F.create_map(*[F.lit(x) for p in LEVEL.items() for x in p])
    known = alerts.join(F.broadcast(relevant), "event")  # a fixed list of events
    grade = F.coalesce(F.try_element_at(severity, F.col("severity")), F.lit(0)) * 10 + F.element_at(level, F.col("level"))
    known = known.withColumn("grade", grade)
    best = F.struct(-F.col("grade"), F.col("ord"))
    told = [c for c in ALERT_TEXTS if c in alerts.columns]
    return known.groupBy(key).agg(
        F.count("*").alias("n_alerts"), F.count_if("affects_travel").alias("n_travel"), F.max("grade").alias("grade"), *[F.min_by(c, best).alias(c) for c in ("event", "severity", "level", "ord", *told)]
    )


def alert_map(places: DataFrame, alerts: DataFrame, key: str) -> DataFrame:
    """``place, alert`` as JSON for every place, null without one: rows of a map to be written."""
    return places.join(alerts, key, "left").select("place", F.when(F.col("event").isNotNull(), F.to_json(F.struct("event", "severity", "level"))).alias("alert"))


def weather_label(code: Column) -> Column:
    """``struct<label, adverse>`` of a WMO weather code: the first bound that isn't below it."""
    # Upper bounds of codes and their labels.
    bounds = [(0, "Clear sky", False), (3, "Partly cloudy", False), (48, "Foggy", True), (55, "Drizzle", True), (57, "Freezing drizzle", True), (65, "Rain", True), (67, "Freezing rain", True), (75, "Snow", True), (77, "Snow grains", True), (82, "Rain showers", True), (86, "Snow showers", True), (95, "Thunderstorm", True), (99, "Thunderstorm with hail", True)]
    exact = {0, 77, 95}
    label, adverse = F, F
    for bound, name, bad in bounds:
        hit = code == bound if bound in exact else code <= bound
        label, adverse = label.when(hit, name), adverse.when(hit, bad)
    return F.struct(label.otherwise("Unknown").alias("label"), adverse.otherwise(False).alias("adverse"))


def event_counts(events: DataFrame, field: str, limit: int | None = None, at_least: int = 1, order: str = "ord") -> DataFrame:
    """How often each value of a field occurs, the most frequent first; equals in the order in which they came first.

    With a limit, ``at_least`` drops rare values after it is taken.
    """
    found = events.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")
    found = found.limit(limit) if limit else found
    return found.where(F.col("n") >= at_least).drop("first")


def cumulative(rows: DataFrame, tier: Column, tiers: list[str]) -> DataFrame:
    """``tier, n``: rows in each tier or a stricter one; ``tiers`` from strict to lax."""
    rank = F.create_map(*[F.lit(x) for k, t in enumerate(tiers) for x in (t, k)])
    counts = rows.groupBy(F.element_at(rank, tier).alias("__k")).agg(F.count("*").alias("__n"))
    names = rows.sparkSession.createDataFrame(list(enumerate(tiers)), "k int, tier string")
    return names.join(F.broadcast(counts), F.col("__k") <= F.col("k"), "left").groupBy("tier").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))  # as many rows as tiers


def last_rows(rows: DataFrame, order: str, n: int = 500) -> DataFrame:
    """The newest rows of a log: what a buffer of ``n`` keeps."""
    return rows.orderBy(F.desc(order)).limit(n)


def transit_stats(places: DataFrame) -> DataFrame:
    """A run's statistics in one row: places with coordinates, with a metro and a bus stop, and the per cent with either.

    Needs place_lat, place_lon, has_metro, has_bus.
    """
    located = F.col("place_lat").isNotNull() & F.col("place_lon").isNotNull()
    either = F.coalesce(F.col("has_metro") | F.col("has_bus"), F.lit(False))
    return places.agg(
        F.count("*").alias("total"), F.count_if(located).alias("with_geo"), F.count_if(~located).alias("no_geo"), F.count_if("has_metro").alias("metro"), F.count_if("has_bus").alias("bus"),
        F.round(100 * F.count_if(located & either) / F.greatest(F.count_if(located), F.lit(1)), 0).cast("long").alias("percent"),
    )


def alert_stats(places: DataFrame) -> DataFrame:
    """A run's statistics in one row: places, with coordinates, with an alert, with one that travellers feel, and calls."""
    located = F.col("place_lat").isNotNull() & F.col("place_lon").isNotNull()
    return places.agg(
        F.count("*").alias("total"), F.count_if(located).alias("with_geo"), F.count_if(~located).alias("no_geo"), F.count("event").alias("alerts_found"),
        F.count_if(F.coalesce(F.col("affects_travel"), F.lit(False))).alias("travel_alerts"), F.count_if(located & F.col("cached")).alias("cache_hits"), F.count_if(located & ~F.col("cached")).alias("api_calls"),
    )


def summary_json(summary: DataFrame, name: str) -> DataFrame:
    """A summary's rows as one JSON document ``{name: [...]}``, in the order of its first column.

    A summary has a row for each kind of event, so the document is small whatever the log's size.
    """
    rows = F.array_sort(F.collect_list(F.struct(*summary.columns)))
    return summary.agg(F.to_json(F.struct(rows.alias(name))).alias("document"))


def produced(rows: DataFrame, kind: Column, at: Column, **fields: Column) -> DataFrame:
    """Events as their producers write them: ``event, ts`` (ISO, UTC) and the fields of that kind, the others null.

    ``fields``: the value of each nullable column, already null for kinds that don't have it.
    """
    return rows.select(kind.alias("event"), iso(at).alias("ts"), *[v.alias(n) for n, v in fields.items()])
