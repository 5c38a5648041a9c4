"""Queries of a person who looks for a place."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo, hours, text
from tessera.operators import equity, ranking
from tessera.plans.catalogue import query
from tessera.plans.domain import AT_LAT, AT_LON, HAVERSINE, STATE, WITH, by_hours, places, with_status

_D = HAVERSINE.format(a_lat=f"{AT_LAT}e0", a_lon=f"({AT_LON}e0)", b_lat="place_lat", b_lon="place_lon")
_TRUST = "least(100, 80 + CASE WHEN n_sources >= 3 THEN 15 WHEN n_sources >= 2 THEN 10 ELSE 0 END + CASE WHEN length(hours) > 0 THEN 5 ELSE 0 END + CASE WHEN length(phone) > 0 AND length(website) > 0 THEN 5 ELSE 0 END)"
_SCORED = WITH + f"""
, seen AS (SELECT *, {_D} AS distance_m, {STATE} AS state, {_TRUST} / 100e0 AS trust, {_TRUST} AS hundredths FROM place)
, timed AS (SELECT *, CAST(floor(distance_m / (1.4e0 / 1.2e0) / 60 + 0.5e0) AS BIGINT) AS walk_min, greatest(2, CAST(floor(distance_m / 1000 / 30e0 * 60 + 0.5e0) AS BIGINT)) AS drive_min FROM seen)
, factors AS (SELECT *, greatest(0e0, 1 - distance_m / 1609.344e0 / 8) AS proximity, CASE state WHEN 'open' THEN 1e0 WHEN 'opens_today' THEN 0.85e0 WHEN 'opens_this_week' THEN 0.5e0 ELSE 0.2e0 END AS timing,
  1 - least(CASE WHEN is_appointment THEN 0.35e0 ELSE 0e0 END + CASE WHEN is_photo_id THEN 0.2e0 ELSE 0e0 END + CASE WHEN is_proof THEN 0.15e0 ELSE 0e0 END + CASE WHEN is_income THEN 0.2e0 ELSE 0e0 END, 1e0) AS ease,
  CASE WHEN speaks_es THEN 1e0 ELSE 0.5e0 END AS language, CASE WHEN main_service IN ('delivery', 'hot_meals') THEN 1e0 ELSE 0.15e0 END AS service FROM timed)
"""


def _ranked_sql(mode: str) -> str:
    w = ranking.WEIGHTS[mode]
    service = "service" if mode == "preference" else "1e0"
    score = " + ".join(f"{f} * {x}e0" for f, x in zip(["proximity", "timing", "ease", "trust", "language", "tone", service], w, strict=True))
    return _SCORED + f", ranked AS (SELECT *, round({score}, 6) AS score FROM factors ORDER BY score DESC, place LIMIT 30)"


def _person(mode: str = "closest", **more):
    return ranking.Person(AT_LAT, AT_LON, mode, ["es"], **more)


def _seen(spark, sf_dir):
    rows = with_status(places(spark, sf_dir))
    filled = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("hours", "phone", "website")]
    rows = rows.withColumn("r", ranking.reliability(F.col("n_sources"), *filled))
    return rows.withColumns({"trust": F.col("r.score"), "tier": F.col("r.tier")}).drop("r")


@query(_ranked_sql("closest") + "SELECT place, score, walk_min, drive_min, state FROM ranked")
def rank_closest(spark, sf_dir):
    return ranking.rank(_seen(spark, sf_dir), _person()).select("place", "score", "walk_min", "drive_min", "state")


@query(_ranked_sql("most_private") + "SELECT place, score FROM ranked")
def rank_most_private(spark, sf_dir):
    return ranking.rank(_seen(spark, sf_dir), _person("most_private")).select("place", "score")


@query(_ranked_sql("most_welcoming") + "SELECT place, score FROM ranked")
def rank_most_welcoming(spark, sf_dir):
    return ranking.rank(_seen(spark, sf_dir), _person("most_welcoming")).select("place", "score")


@query(_ranked_sql("preference") + "SELECT place, score, main_service FROM ranked")
def rank_with_intent(spark, sf_dir):
    return ranking.rank(_seen(spark, sf_dir), _person(services=["delivery", "hot_meals"])).select("place", "score", "main_service")


@query(_ranked_sql("closest") + ", long AS (UNPIVOT (SELECT place, round(proximity, 6) AS proximity, timing, ease, trust, language, tone, 1e0 AS service FROM ranked) ON proximity, timing, ease, trust, language, tone, service INTO NAME factor VALUE value) SELECT place, factor, round(value, 6) AS value FROM long")
def rank_breakdown(spark, sf_dir):
    return ranking.breakdown(ranking.rank(_seen(spark, sf_dir), _person())).withColumn("value", F.round("value", 6))


@query(_SCORED + "SELECT place, state, round(distance_m, 3) AS distance_m FROM factors ORDER BY CASE state WHEN 'open' THEN 0 WHEN 'opens_today' THEN 1 WHEN 'opens_this_week' THEN 2 ELSE 3 END, factors.distance_m, place LIMIT 30")
def rank_open_tier_distance(spark, sf_dir):
    return ranking.by_tier_and_distance(ranking.factors(_seen(spark, sf_dir), _person())).select("place", "state", F.round("distance_m", 3).alias("distance_m"))


@query(_ranked_sql("closest") + """, parts AS (SELECT place, CASE WHEN walk_min <= 20 THEN walk_min || ' min walk' WHEN stop_name IS NOT NULL THEN 'near ' || split_part(stop_name, ' (', 1) END AS a,
 CASE state WHEN 'open' THEN 'open now' WHEN 'opens_today' THEN 'opens today' END AS b, CASE WHEN NOT is_appointment AND (is_no_id OR NOT is_photo_id) THEN 'no ID needed' END AS c,
 CASE WHEN speaks_es THEN 'Spanish spoken' WHEN speaks_am THEN 'Amharic spoken' END AS d FROM ranked)
 SELECT place, CASE WHEN concat_ws(', ', a, b, c, d) <> '' THEN concat_ws(', ', a, b, c, d) || '.' ELSE '' END AS why FROM parts""")
def rank_explain(spark, sf_dir):
    found = ranking.rank(_seen(spark, sf_dir), _person())
    spoken = F.array(F.lit("es"), F.lit("am"))
    return found.select("place", text.explanation(F.col("walk_min"), F.col("stop_name"), F.col("state"), F.col("requirements"), F.col("languages"), spoken).alias("why"))


@query(_SCORED + """SELECT place, CASE WHEN walk_min <= 20 THEN walk_min || ' min walk' WHEN length(stop_name) > 0 THEN 'near ' || stop_name
 WHEN walk_min + CAST(floor(distance_m / 1609.344e0 / 15 * 60 + 0.5e0) AS BIGINT) <= 40 THEN walk_min + CAST(floor(distance_m / 1609.344e0 / 15 * 60 + 0.5e0) AS BIGINT) || ' min by transit' ELSE drive_min || ' min drive' END AS label FROM factors""")
def best_mode_label(spark, sf_dir):
    rows = ranking.factors(_seen(spark, sf_dir), _person())
    transit = geo.transit_minutes(F.col("walk_min"), F.lit(None).cast("double"), F.col("distance_m"))
    return rows.select("place", text.mode_label(F.col("walk_min"), F.lit(None).cast("string"), F.col("stop_name"), transit, F.col("drive_min")).alias("label"))


@query(WITH + f"""SELECT place, {STATE} AS state, CASE place % 6 WHEN 1 THEN 'Open now - closes 5pm' WHEN 2 THEN 'Open now - closes 12pm' WHEN 3 THEN 'Saturday 10am' WHEN 5 THEN 'Tomorrow 10am' ELSE 'Call for hours' END AS label FROM place""")
def open_status_at(spark, sf_dir):
    return with_status(places(spark, sf_dir)).select("place", "state", F.col("state_label").alias("label"))


_HOURS = """SELECT place, unnest(CASE place % 6 WHEN 1 THEN ['mon 09:00 17:00'] WHEN 2 THEN ['mon 09:30 12:00', 'wed 13:00 16:30'] WHEN 3 THEN ['sat 10:00 14:00'] WHEN 5 THEN ['tue 10:00 14:00', 'thu 10:00 14:00 bring a bag'] ELSE [] END) AS entry FROM place"""


@query(WITH + _HOURS)
def hours_parse(spark, sf_dir):
    rows = by_hours(places(spark, sf_dir).select("place", "hours"), F.explode("entries").alias("e"))
    return rows.select("place", F.concat_ws(" ", "e.day", "e.open", "e.close", "e.note").alias("entry"))


@query(WITH + "SELECT place, unnest(CASE place % 6 WHEN 1 THEN ['mon'] WHEN 2 THEN ['mon', 'wed'] WHEN 3 THEN ['sat'] WHEN 5 THEN ['tue', 'thu'] ELSE [] END) AS day, 1 AS n_slots FROM place")
def weekly_schedule(spark, sf_dir):
    week = hours.schedule(F.col("entries"), F.col("hours"))
    rows = by_hours(places(spark, sf_dir).select("place", "hours"), F.explode(week["days"]).alias("day", "slots"))
    return rows.select("place", "day", F.size("slots").alias("n_slots"))


@query(_SCORED + "SELECT place FROM factors WHERE state = 'open' AND speaks_es AND (is_no_id OR NOT is_photo_id)")
def facet_filter(spark, sf_dir):
    return ranking.facets(ranking.factors(_seen(spark, sf_dir), _person()), "open", "es", "no_id").select("place")


@query(_SCORED + "SELECT place FROM factors WHERE walk_min <= 20 OR (main_service = 'delivery' AND state IN ('open', 'opens_today'))")
def facet_walk_or_delivered(spark, sf_dir):
    rows = ranking.factors(_seen(spark, sf_dir), _person())
    return ranking.facets(rows, "walk").select("place").union(ranking.facets(rows, "delivers", "today").select("place")).distinct()


@query(_SCORED + "SELECT place, CASE place % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS urgency, round(distance_m, 3) AS distance_m FROM factors WHERE (accepts_food OR accepts_money) AND distance_m / 1609.344e0 <= 5")
def donor_list(spark, sf_dir):
    rows = ranking.factors(_seen(spark, sf_dir), _person()).withColumn("urgency", F.when(F.col("place") % 3 == 0, "high").when(F.col("place") % 3 == 1, "medium"))
    return ranking.donors(rows, 5).select("place", "urgency", F.round("distance_m", 3).alias("distance_m"))


@query(_SCORED + "SELECT place, round(distance_m, 3) AS distance_m FROM factors WHERE accepts_volunteers AND distance_m / 1609.344e0 <= 10 AND length(website) > 0 AND speaks_es")
def volunteer_list(spark, sf_dir):
    rows = ranking.factors(_seen(spark, sf_dir), _person()).withColumn("volunteer_url", F.lit(None).cast("string"))
    return ranking.volunteers(rows, 10, with_url=True, spanish=True).select("place", F.round("distance_m", 3).alias("distance_m"))


@query(_SCORED + "SELECT place, trust FROM factors WHERE length(hero_copy) > 0 AND state IN ('open', 'opens_today') ORDER BY trust DESC, place LIMIT 4")
def trending_top4(spark, sf_dir):
    return ranking.trending(_seen(spark, sf_dir)).select("place", "trust")


@query(_ranked_sql("closest") + ", hero AS (SELECT place FROM ranked WHERE hundredths >= 70 ORDER BY score DESC, place LIMIT 1) SELECT place, score FROM ranked WHERE place NOT IN (SELECT place FROM hero) ORDER BY score DESC, place LIMIT 5")
def backups_excluding_hero(spark, sf_dir):
    return ranking.backups(ranking.rank(_seen(spark, sf_dir), _person())).select("place", "score")


@query(_SCORED + "SELECT place, CASE WHEN hundredths >= 90 THEN 'fresh' WHEN hundredths >= 70 THEN 'recent' WHEN hundredths >= 40 THEN 'stale' ELSE 'unknown' END AS tier, trust FROM factors")
def reliability_tier(spark, sf_dir):
    return _seen(spark, sf_dir).select("place", "tier", "trust")


@query(WITH + "SELECT place, CASE WHEN is_walk_in AND is_no_id THEN 'low_friction' WHEN is_walk_in THEN 'any_walk_in' ELSE 'appointment_ok' END AS tier FROM place")
def dignity_tiers(spark, sf_dir):
    return places(spark, sf_dir).select("place", equity.dignity_tier(F.col("requirements")).alias("tier"))


@query(_SCORED + "SELECT place FROM factors ORDER BY distance_m, place LIMIT 40 OFFSET 40")
def second_page(spark, sf_dir):
    return ranking.page(ranking.factors(_seen(spark, sf_dir), _person()), ["distance_m", "place"], 1, 40).select("place")
