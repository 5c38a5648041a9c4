"""Queries on areas, access and transit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo, hours
from tessera.operators import equity, spatial
from tessera.operators.ranking import cursor
from tessera.plans.catalogue import query
from tessera.plans.domain import HAVERSINE, WITH, areas, by_hours, places, stations

_NEAR = WITH + f"""
, near AS (SELECT a.area, p.*, {HAVERSINE.format(a_lat='p.place_lat', a_lon='p.place_lon', b_lat='a.lat', b_lon='a.lon')} AS distance_m FROM place p, area a
  WHERE {HAVERSINE.format(a_lat='p.place_lat', a_lon='p.place_lon', b_lat='a.lat', b_lon='a.lon')} <= 3000)
, supply AS (SELECT area, count(*) AS n_places, sum(5 + CASE WHEN length(hours) > 0 THEN 3 ELSE 0 END + CASE WHEN is_walk_in THEN 2 ELSE 0 END) AS tenths FROM near GROUP BY area)
, needed AS (SELECT a.*, coalesce(n_places, 0) AS n_places, coalesce(tenths, 0) / 10e0 AS units, round(poverty * 0.6e0 + snap * 0.4e0, 3) AS need FROM area a LEFT JOIN supply USING (area))
, supplied AS (SELECT *, round(least(need, units / greatest(1e0, population / 5000e0) * need), 3) AS supply FROM needed)
, gaps AS (SELECT *, round(greatest(0e0, need - supply), 3) AS gap, CAST(floor(population * round(greatest(0e0, need - supply), 3)) AS BIGINT) AS underserved FROM supplied)
"""


def _gaps(spark, sf_dir):
    return equity.gaps(areas(spark, sf_dir), places(spark, sf_dir).withColumnRenamed("is_walk_in", "walk_in").drop("area"))


@query(_NEAR + "SELECT area, label, need, supply, gap, n_places, underserved FROM gaps ORDER BY gap DESC, area LIMIT 30")
def equity_gap_top30(spark, sf_dir):
    return equity.top_gaps(_gaps(spark, sf_dir)).select("area", "label", "need", "supply", "gap", "n_places", "underserved")


@query(_NEAR + ", worst AS (SELECT * FROM gaps ORDER BY gap DESC, area LIMIT 30) SELECT (SELECT count(*) FROM gaps) AS areas, (SELECT round(sum(CAST(round(gap * 1000) AS BIGINT)) / 1000e0 / count(*), 3) FROM gaps) AS mean_gap, (SELECT area FROM gaps ORDER BY gap DESC, area LIMIT 1) AS worst_area, count(*) AS kept, CAST(sum(underserved) AS BIGINT) AS underserved FROM worst")
def equity_summary(spark, sf_dir):
    return equity.gap_summary(_gaps(spark, sf_dir))


@query(_NEAR + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY distance_m, place) AS rn FROM near) SELECT area, place AS host, place_name AS host_name, round(distance_m / 1000, 2) AS distance_km, coalesce(length(hours) > 0, false) AS has_hours FROM ranked WHERE rn = 1")
def equity_hosts(spark, sf_dir):
    found = _gaps(spark, sf_dir).where("host IS NOT NULL")
    return found.select("area", F.col("host.place").alias("host"), F.col("host.place_name").alias("host_name"), F.round(F.col("host.distance_m") / 1000, 2).alias("distance_km"), F.col("host.has_hours").alias("has_hours"))


@query(_NEAR + """SELECT area, CASE WHEN gap <= 0.01 THEN NULL WHEN gap >= 0.06 THEN 'high' WHEN gap >= 0.03 THEN 'medium' ELSE 'low' END AS level,
 CASE WHEN gap > 0.01 THEN round(gap / 0.03e0, 1) END AS multiplier FROM gaps""")
def urgency_signal(spark, sf_dir):
    return _gaps(spark, sf_dir).withColumn("u", equity.urgency(F.col("gap"))).select("area", F.col("u.level").alias("level"), F.col("u.multiplier").alias("multiplier"))


@query(_NEAR + """SELECT area, CASE WHEN n_places = 0 THEN 'Nothing is within walking distance in ' || label || ' (' || format('{:,}', population) || ' residents).'
 WHEN need >= 0.20 AND n_places <= 2 THEN label || ': ' || CAST(floor(need * 100) AS BIGINT) || '% need, only ' || n_places || ' resource' || CASE WHEN n_places = 1 THEN '' ELSE 's' END || ' for ' || format('{:,}', population) || ' residents.'
 WHEN need >= 0.15 AND n_places <= 4 THEN label || ' is underserved: ' || n_places || ' resource' || CASE WHEN n_places = 1 THEN '' ELSE 's' END || ' for ' || format('{:,}', population) || ' residents at ' || CAST(floor(need * 100) AS BIGINT) || '% need.'
 ELSE label || ' is stretched: ' || n_places || ' resource' || CASE WHEN n_places = 1 THEN '' ELSE 's' END || ' at ' || CAST(floor(need * 100) AS BIGINT) || '% need for ' || format('{:,}', population) || ' residents.' END AS why FROM gaps""")
def equity_why(spark, sf_dir):
    return _gaps(spark, sf_dir).select("area", equity.why_gap(F.col("label"), F.col("need"), F.col("n_places"), F.col("population")).alias("why"))


def _access(spark, sf_dir):
    rows = places(spark, sf_dir).drop("area")
    names = {"en": "English", "es": "Spanish", "am": "Amharic", "fr": "French"}
    spoken = F.transform("languages", lambda x: F.element_at(F.create_map(*[F.lit(v) for p in names.items() for v in p]), x))
    rows = by_hours(rows.withColumn("languages", spoken), *[hours.open_on(d, F.col("entries"), F.col("hours")).alias(f"open_{d}") for d in hours.DAYS])
    return equity.access(areas(spark, sf_dir), rows)


_OPEN = {"mon": "(0, 1, 2, 4)", "tue": "(0, 4, 5)", "wed": "(0, 2, 4)", "thu": "(0, 4, 5)", "fri": "(0, 4)", "sat": "(0, 3, 4)", "sun": "(0, 4)"}
_ACCESS = _NEAR + f""", access AS (SELECT a.area, count(n.place) AS n_places, {', '.join(f"count(CASE WHEN n.place % 6 IN {v} THEN 1 END) AS open_{d}" for d, v in _OPEN.items())},
 count(n.place) AS speaks_english, count(CASE WHEN speaks_es THEN 1 END) AS speaks_spanish, count(CASE WHEN speaks_am THEN 1 END) AS speaks_amharic, count(CASE WHEN speaks_fr THEN 1 END) AS speaks_french,
 count(CASE WHEN is_walk_in AND is_no_id THEN 1 END) AS low_friction, count(CASE WHEN is_walk_in THEN 1 END) AS any_walk_in, count(n.place) AS appointment_ok
 FROM area a LEFT JOIN near n ON a.area = n.area GROUP BY a.area)
, scored AS (SELECT *, CASE WHEN n_places = 0 THEN 0e0 ELSE round(({' + '.join(f'CASE WHEN open_{d} > 0 THEN 1 ELSE 0 END' for d in _OPEN)}) / 7e0 * 0.4e0 + CASE WHEN low_friction > 0 THEN 1e0 WHEN any_walk_in > 0 THEN 0.5e0 ELSE 0.2e0 END * 0.3e0 + least(1e0, n_places / 5e0) * 0.3e0, 2) END AS access_score FROM access)
"""


@query(_ACCESS + f"SELECT area, n_places, {', '.join(f'open_{d}' for d in _OPEN)} FROM scored")
def access_by_day(spark, sf_dir):
    return _access(spark, sf_dir).select("area", "n_places", *[f"open_{d}" for d in hours.DAYS])


@query(_ACCESS + "SELECT area, speaks_english, speaks_spanish, speaks_amharic, speaks_french FROM scored")
def access_by_language(spark, sf_dir):
    return _access(spark, sf_dir).select("area", "speaks_english", "speaks_spanish", "speaks_amharic", "speaks_french")


@query(_ACCESS + "SELECT area, low_friction, any_walk_in, appointment_ok, access_score FROM scored")
def access_dignity(spark, sf_dir):
    return _access(spark, sf_dir).select("area", *equity.TIERS, "access_score")


@query(_ACCESS + "SELECT area, access_score FROM scored ORDER BY access_score, area LIMIT 5")
def access_worst5(spark, sf_dir):
    return _access(spark, sf_dir).select("area", "access_score").orderBy("access_score", "area").limit(5)


@query(_ACCESS + "SELECT count(*) AS areas, round(sum(CAST(round(access_score * 100) AS BIGINT)) / 100e0 / count(*), 2) AS mean_score, count(CASE WHEN n_places = 0 THEN 1 END) AS without_places, count(CASE WHEN n_places > 0 AND open_sat = 0 AND open_sun = 0 THEN 1 END) AS weekend_gap, count(CASE WHEN n_places > 0 AND low_friction = 0 THEN 1 END) AS without_low_friction FROM scored")
def access_summary(spark, sf_dir):
    return equity.access_summary(_access(spark, sf_dir))


_KNN = WITH + f"""
, pairs AS (SELECT p.place, s.station, s.is_metro, {HAVERSINE.format(a_lat='p.place_lat', a_lon='p.place_lon', b_lat='s.s_lat', b_lon='s.s_lon')} AS distance_m FROM place p, station s)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY distance_m, station) AS rank FROM pairs WHERE distance_m <= 3000)
, kinds AS (SELECT *, row_number() OVER (PARTITION BY place, is_metro ORDER BY distance_m, station) AS rank FROM pairs WHERE distance_m <= 3000)
, best AS (SELECT place, min(CASE WHEN is_metro THEN round(distance_m * 1.3e0 / 1.33e0 / 60, 1) END) AS metro_min, min(CASE WHEN NOT is_metro THEN round(distance_m * 1.3e0 / 1.33e0 / 60, 1) END) AS bus_min FROM kinds
  WHERE rank <= 3 AND (NOT is_metro OR distance_m * 1.3e0 <= 3000) GROUP BY place)
"""


@query(_KNN + "SELECT place, station, rank, round(distance_m, 3) AS distance_m FROM ranked WHERE rank <= 3")
def nearest_station_k3(spark, sf_dir):
    found = spatial.nearest(places(spark, sf_dir), stations(spark, sf_dir), 3, 3000.0, "place", "station", ("place_lat", "place_lon"), ("s_lat", "s_lon"))
    return found.select("place", "station", F.col("rank").cast("long").alias("rank"), F.round("distance_m", 3).alias("distance_m"))


def _modes(spark, sf_dir):
    """Walking minutes to the best metro and bus stop of the three nearest of each kind; the metro's network distance is bounded too."""
    people_at, stops = places(spark, sf_dir), stations(spark, sf_dir)
    out = people_at.select("place")
    for name, metro in (("metro_min", True), ("bus_min", False)):
        near = spatial.nearest(people_at, stops.where(F.col("is_metro") == metro), 3, 3000.0, "place", "station", ("place_lat", "place_lon"), ("s_lat", "s_lon"))
        walk = geo.network_metres(F.col("distance_m"))
        near = near.where(walk <= 3000) if metro else near.where(walk <= 4500)
        out = out.join(near.groupBy("place").agg(F.min(geo.network_walk_minutes(walk)).alias(name)), "place", "left")
    return out.withColumn("mode", geo.transit_mode(F.col("metro_min"), F.col("bus_min")))


@query(_KNN + """SELECT p.place, metro_min, bus_min, CASE WHEN metro_min IS NOT NULL AND (bus_min IS NULL OR metro_min * 1.5e0 + 3.6e0 <= bus_min * 1.5e0 + 12e0) THEN 'metro' WHEN bus_min IS NOT NULL THEN 'bus' END AS mode
 FROM place p LEFT JOIN best USING (place)""")
def transit_mode_choice(spark, sf_dir):
    return _modes(spark, sf_dir)


@query(_KNN + "SELECT p.place, CASE WHEN metro_min IS NOT NULL THEN 123 ELSE 0 END AS n_hours FROM place p LEFT JOIN best USING (place)")
def transit_reachable_hours(spark, sf_dir):
    return _modes(spark, sf_dir).select("place", F.size(hours.reachable_hours(F.col("metro_min").isNotNull())).alias("n_hours"))


@query(WITH + f"SELECT a.area, count(*) AS n_places, round(min({HAVERSINE.format(a_lat='p.place_lat', a_lon='p.place_lon', b_lat='a.lat', b_lon='a.lon')}), 3) AS nearest_m FROM area a, place p WHERE {HAVERSINE.format(a_lat='p.place_lat', a_lon='p.place_lon', b_lat='a.lat', b_lon='a.lon')} <= 3000 GROUP BY a.area")
def radius_counts(spark, sf_dir):
    near = spatial.within(places(spark, sf_dir).drop("area"), areas(spark, sf_dir), 3000.0, ("place_lat", "place_lon"), ("lat", "lon"))
    return near.groupBy("area").agg(F.count("*").alias("n_places"), F.round(F.min("distance_m"), 3).alias("nearest_m"))


@query(WITH + "SELECT area, round(poverty * 0.6e0 + snap * 0.4e0, 3) AS need FROM area")
def need_score(spark, sf_dir):
    return areas(spark, sf_dir).select("area", equity.need(F.col("poverty"), F.col("snap")).alias("need"))


@query(_NEAR + ", top AS (SELECT area, gap FROM gaps ORDER BY gap DESC, area LIMIT 30) SELECT area, coalesce(lag(area) OVER (ORDER BY gap DESC, area), last_value(area) OVER (ORDER BY gap DESC, area ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous, coalesce(lead(area) OVER (ORDER BY gap DESC, area), first_value(area) OVER (ORDER BY gap DESC, area)) AS next FROM top")
def gap_cursor(spark, sf_dir):
    return cursor(equity.top_gaps(_gaps(spark, sf_dir)).select("area", "gap"), [F.desc("gap"), "area"], "area").select("area", "previous", "next")
