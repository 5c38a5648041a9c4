"""Queries on gaps as places, documents and people see them, on runs and on events as they are produced."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hours
from tessera.operators import equity, metrics
from tessera.plans.catalogue import query
from tessera.plans.domain import WITH, events, places
from tessera.plans.places import _NEAR, _gaps
from tessera.session import table

#: When the documents are made, so that they are the same each time.
AS_OF = "2024-06-01 12:00:00"

_URGENT = _NEAR + """, worst AS (SELECT * FROM gaps ORDER BY gap DESC, area LIMIT 30), urgent AS (SELECT area, CASE WHEN gap <= 0.01 THEN NULL WHEN gap >= 0.06 THEN 'high' WHEN gap >= 0.03 THEN 'medium' ELSE 'low' END AS level,
 CASE WHEN gap > 0.01 THEN round(gap / 0.03e0, 1) END AS multiplier, underserved FROM worst)
"""


@query(_URGENT + "SELECT place, p.area, level, multiplier, underserved FROM place p LEFT JOIN urgent USING (area)")
def place_gap(spark, sf_dir):
    return equity.with_gap(places(spark, sf_dir), _gaps(spark, sf_dir)).select("place", "area", "level", "multiplier", "underserved")


@query(_NEAR + "SELECT count(CASE WHEN gap > 0.03 THEN 1 END) AS underserved_areas, count(*) AS areas FROM gaps")
def underserved_count(spark, sf_dir):
    return equity.underserved_areas(_gaps(spark, sf_dir))


@query(_NEAR + "SELECT area, round(least(need / 0.3e0 * 100, 100e0), 6) AS need_bar, round(least(supply / 0.3e0 * 100, 100e0), 6) AS supply_bar, round(least(gap / 0.15e0 * 100, 100e0), 6) AS gap_bar FROM gaps")
def gap_bars(spark, sf_dir):
    return _gaps(spark, sf_dir).select("area", *[F.round(equity.bars(F.col(c), full), 6).alias(f"{c}_bar") for c, full in (("need", 0.3), ("supply", 0.3), ("gap", 0.15))])


_GAP_LIST = "list(json_object('area', area, 'label', label, 'milli', CAST(round(gap * 1000) AS BIGINT), 'underserved', underserved) ORDER BY gap DESC, area)"


@query(_NEAR + f", worst AS (SELECT * FROM gaps ORDER BY gap DESC, area LIMIT 30) SELECT '{{\"generatedAt\":\"2024-06-01T12:00:00Z\",\"totalOrgs\":' || (SELECT count(*) FROM place) || ',\"equityGaps\":[' || array_to_string({_GAP_LIST}, ',') || ']}}' AS document FROM worst")
def gap_payload(spark, sf_dir):
    """The document that people download: thirty gaps, so it is small."""
    gap = F.struct(F.col("area"), F.col("label"), F.round(F.col("gap") * 1000).cast("long").alias("milli"), F.col("underserved"))
    listed = equity.top_gaps(_gaps(spark, sf_dir)).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("gap")).alias("rank"), "area", gap.alias("gap")))), lambda x: x["gap"]).alias("gaps"))
    total = places(spark, sf_dir).agg(F.count("*").alias("n"))
    document = F.struct(hours.iso(F.lit(AS_OF).cast("timestamp")).alias("generatedAt"), F.col("n").alias("totalOrgs"), F.col("gaps").alias("equityGaps"))
    return listed.join(F.broadcast(total)).select(F.to_json(document).alias("document"))  # one row each


@query(_NEAR + """, worst AS (SELECT * FROM gaps ORDER BY gap DESC, area LIMIT 30) SELECT '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"area":' || area || ',"underserved":' || underserved || '}}', ',' ORDER BY gap DESC, area) || ']}' AS document FROM worst""")
def gap_features(spark, sf_dir):
    """Thirty gaps as a feature collection."""
    worst = equity.top_gaps(_gaps(spark, sf_dir)).withColumn("rank", F.struct(-F.col("gap"), F.col("area")))
    geometry = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.col("lon"), F.lit(","), F.col("lat"), F.lit(']},"properties":'), F.to_json(F.struct("area", "underserved")), F.lit("}"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", geometry.alias("feature")))), lambda x: x["feature"])
    return worst.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("document"))


@query(WITH + "SELECT place, source FROM place WHERE source = 'cafb' ORDER BY place LIMIT 25")
def rows_of_a_source(spark, sf_dir):
    """A run over one source and a number of its rows, by their places in the input."""
    return places(spark, sf_dir).where("source = 'cafb'").orderBy("place").limit(25).select("place", "source")


@query(WITH + """, s AS (SELECT place, place % 10 <> 3 AS located, place % 5 = 0 AS has_metro, place % 3 = 0 AS has_bus FROM place)
 SELECT count(*) AS total, count(CASE WHEN located THEN 1 END) AS with_geo, count(CASE WHEN NOT located THEN 1 END) AS no_geo, count(CASE WHEN has_metro THEN 1 END) AS metro, count(CASE WHEN has_bus THEN 1 END) AS bus,
 CAST(round(100e0 * count(CASE WHEN located AND (has_metro OR has_bus) THEN 1 END) / greatest(count(CASE WHEN located THEN 1 END), 1), 0) AS BIGINT) AS percent FROM s""")
def transit_run_stats(spark, sf_dir):
    rows = places(spark, sf_dir).withColumn("place_lat", F.when(F.col("place") % 10 != 3, F.col("place_lat")))
    return metrics.transit_stats(rows.withColumns({"has_metro": F.col("place") % 5 == 0, "has_bus": F.col("place") % 3 == 0}))


@query(WITH + """SELECT count(*) AS total, count(CASE WHEN place % 10 <> 3 THEN 1 END) AS with_geo, count(CASE WHEN place % 10 = 3 THEN 1 END) AS no_geo, count(CASE WHEN place % 4 = 0 THEN 1 END) AS alerts_found, count(CASE WHEN place % 8 = 0 THEN 1 END) AS travel_alerts,
 count(CASE WHEN place % 10 <> 3 AND place % 2 = 0 THEN 1 END) AS cache_hits, count(CASE WHEN place % 10 <> 3 AND place % 2 = 1 THEN 1 END) AS api_calls FROM place""")
def weather_run_stats(spark, sf_dir):
    rows = places(spark, sf_dir).withColumn("place_lat", F.when(F.col("place") % 10 != 3, F.col("place_lat")))
    return metrics.alert_stats(rows.withColumns({"event": F.when(F.col("place") % 4 == 0, "Flood Watch"), "affects_travel": F.when(F.col("place") % 8 == 0, True), "cached": F.col("place") % 2 == 0}))


@query(WITH + """SELECT place, CASE place % 5 WHEN 0 THEN 'sage' WHEN 1 THEN 'mustard' ELSE 'stone' END AS tone, place % 5 < 2 AS promote, place % 5 >= 2 AS call_first FROM place""")
def freshness_tones(spark, sf_dir):
    tier = F.element_at(F.array(*[F.lit(x) for x in ("verified", "likely", "stale", "unknown", None)]), (F.col("place") % 5 + 1).cast("int"))
    return places(spark, sf_dir).withColumn("f", hours.freshness(tier)).select("place", "f.*")


@query("""SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders""")
def iso_timestamps(spark, sf_dir):
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    return table(spark, sf_dir, "orders").select("o_orderkey", hours.iso(at).alias("iso"))


_AGO = """WITH t AS (SELECT event_id, epoch(TIMESTAMP '2024-06-01 12:00:00') - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), u AS (SELECT event_id, s, CASE WHEN abs(s) >= 31536000 THEN 31536000 WHEN abs(s) >= 2592000 THEN 2592000 WHEN abs(s) >= 86400 THEN 86400 WHEN abs(s) >= 3600 THEN 3600 WHEN abs(s) >= 60 THEN 60 ELSE 1 END AS l FROM t)
, w AS (SELECT *, CAST(round(abs(s) / CAST(l AS DOUBLE)) AS BIGINT) AS n, CASE l WHEN 31536000 THEN 'year' WHEN 2592000 THEN 'month' WHEN 86400 THEN 'day' WHEN 3600 THEN 'hour' WHEN 60 THEN 'minute' ELSE 'second' END AS unit FROM u)
SELECT event_id, CASE WHEN s >= 0 THEN n || ' ' || unit || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' ELSE 'in ' || n || ' ' || unit || CASE WHEN n = 1 THEN '' ELSE 's' END END AS ago FROM w"""


@query(_AGO)
def relative_times(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", hours.ago(F.col("ts"), F.lit(AS_OF).cast("timestamp")).alias("ago"))


_KINDS = "CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'filter' ELSE 'search' END"
_PRODUCED = f"""WITH e AS (SELECT *, {_KINDS} AS event FROM events)
SELECT event, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS ts, CASE WHEN event = 'search' THEN CAST(20000 + user_id % 100 AS VARCHAR) END AS zip, CASE WHEN event = 'click' THEN CAST(user_id AS VARCHAR) END AS org_id,
 CASE WHEN event = 'click' THEN substr(repeat('name of ', 9) || user_id, 1, 50) END AS org_name, CASE WHEN event = 'filter' THEN 'open_now' END AS filter, CASE WHEN event = 'filter' THEN user_id % 2 = 0 END AS value, CASE WHEN event = 'page_view' THEN 'map' END AS page FROM e"""


def _produced(spark, sf_dir):
    rows, kind = events(spark, sf_dir), F.when(F.col("event_type") == "view", "page_view").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "signup", "filter").otherwise("search")
    of = lambda name, value: F.when(kind == name, value)
    name = F.substr(F.concat(F.repeat(F.lit("name of "), 9), F.col("user_id").cast("string")), F.lit(1), F.lit(50))
    fields = {"zip": of("search", (20000 + F.col("user_id") % 100).cast("string")), "org_id": of("click", F.col("user_id").cast("string")), "org_name": of("click", name), "filter": of("filter", F.lit("open_now")), "value": of("filter", F.col("user_id") % 2 == 0), "page": of("page_view", F.lit("map"))}
    return metrics.produced(rows, kind, F.col("ts"), **fields)


@query(_PRODUCED)
def events_produced(spark, sf_dir):
    return _produced(spark, sf_dir)


@query(f"""WITH c AS (SELECT {_KINDS} AS event, count(*) AS n FROM events GROUP BY 1) SELECT '{{"events":[' || string_agg('{{"event":"' || event || '","n":' || n || '}}', ',' ORDER BY event) || ']}}' AS document FROM c""")
def event_summary_document(spark, sf_dir):
    return metrics.summary_json(_produced(spark, sf_dir).groupBy("event").agg(F.count("*").alias("n")), "events")
