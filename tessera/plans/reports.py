"""Reports on completeness, coverage, events and alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.geo import cell_key
from tessera.functions.text import phone
from tessera.operators import equity, frequent, metrics
from tessera.plans.catalogue import query
from tessera.plans.domain import WITH, events, places, records
from tessera.session import shared_folder, table
from tessera.streaming import events as stream

_FIELDS = ["phone", "website", "hours", "hero_copy"]


def _long(source: str, fields: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS field, count(CASE WHEN length({f}) > 0 THEN 1 END) AS n_filled, count(*) AS total FROM {source}" for f in fields)


@query(WITH + f"SELECT field, n_filled, round(n_filled * 100 / total, 0) AS percent FROM ({_long('place', _FIELDS)})")
def completeness_report(spark, sf_dir):
    return metrics.completeness(places(spark, sf_dir), _FIELDS)


@query(WITH + "SELECT source, count(*) AS n_records, " + ", ".join(f"count(CASE WHEN length({f}) > 0 THEN 1 END) AS n_{f}" for f in _FIELDS) + " FROM place GROUP BY source")
def metadata_by_source(spark, sf_dir):
    return metrics.by_source(places(spark, sf_dir), "source", _FIELDS)


@query(WITH + "SELECT CASE WHEN CAST(zip AS INT) < 20600 THEN 'near' ELSE 'far' END AS band, source, count(*) AS n FROM place GROUP BY GROUPING SETS ((band, source), (band), ())")
def grouping_sets_by_band_source(spark, sf_dir):
    rows = places(spark, sf_dir).withColumn("band", F.when(F.col("zip").cast("int") < 20600, "near").otherwise("far"))
    return rows.groupingSets([["band", "source"], ["band"], []], "band", "source").agg(F.count("*").alias("n"))


@query(WITH + f", after AS (SELECT phone, coalesce(website, 'https://x.org') AS website, CASE WHEN length(hours) > 0 THEN hours WHEN is_walk_in THEN 'daily' END AS hours, hero_copy FROM place) SELECT a.field, a.n_filled AS before, b.n_filled AS after, b.n_filled - a.n_filled AS change FROM ({_long('place', _FIELDS)}) a JOIN ({_long('after', _FIELDS)}) b USING (field)")
def quality_delta(spark, sf_dir):
    before = places(spark, sf_dir)
    after = before.withColumn("website", F.coalesce("website", F.lit("https://x.org"))).withColumn("hours", F.when(F.length("hours") > 0, F.col("hours")).when(F.col("is_walk_in"), "daily"))
    return metrics.quality_change(before, after, _FIELDS)


@query(WITH + "SELECT 'phone' AS field, count(CASE WHEN length(phone) > 0 THEN 1 END) AS n_changed FROM place UNION ALL SELECT 'hours', count(CASE WHEN hours IS NULL THEN 1 END) FROM place")
def change_counters(spark, sf_dir):
    return metrics.changed(places(spark, sf_dir), {"phone": (F.col("phone"), phone(F.col("phone"))), "hours": (F.col("hours"), F.coalesce("hours", F.lit("")))})


@query(WITH + "SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter(['en', CASE WHEN speaks_es THEN 'es' END, CASE WHEN speaks_am THEN 'am' END, CASE WHEN speaks_fr THEN 'fr' END], lambda x: x IS NOT NULL)) AS tag FROM place) GROUP BY tag")
def tag_distribution(spark, sf_dir):
    return metrics.tag_counts(places(spark, sf_dir), "languages")


@query(WITH + "SELECT 'low_friction' AS tier, count(CASE WHEN is_walk_in AND is_no_id THEN 1 END) AS n FROM place UNION ALL SELECT 'any_walk_in', count(CASE WHEN is_walk_in THEN 1 END) FROM place UNION ALL SELECT 'appointment_ok', count(*) FROM place")
def cumulative_tier_rollup(spark, sf_dir):
    rows = places(spark, sf_dir)
    return metrics.cumulative(rows, equity.dignity_tier(F.col("requirements")), equity.TIERS)


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, count(CASE WHEN quality = 1 THEN 1 END) AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def label_coverage(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").withColumn("known", F.lit(1))
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("known").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))


# Events ----------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type")
def event_summary(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, min(event_id) LIMIT 20")
def event_top_users(spark, sf_dir):
    return metrics.event_counts(events(spark, sf_dir), "user_id", 20, order="event_id")


_TOP = "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, min(event_id) LIMIT 20"


@query(_TOP)
def event_top_users_by_hours(spark, sf_dir):
    """The same from summaries of 40 users an hour, written once; the log is read for what they leave out."""
    log, path = events(spark, sf_dir), f"{shared_folder(spark)}/hours-{uuid.uuid4().hex}"
    frequent.summaries(log, "ts", "user_id", "event_id", 40).write.parquet(path)
    return frequent.most_frequent(spark.read.parquet(path), log, "ts", "user_id", "event_id", 20).withColumnRenamed("value", "user_id")


@query("SELECT * FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 50) WHERE n >= 100")
def event_gap_threshold(spark, sf_dir):
    return metrics.event_counts(events(spark, sf_dir), "k", 50, 100, order="event_id")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def event_last_500(spark, sf_dir):
    return metrics.last_rows(events(spark, sf_dir), "event_id").select("event_id", "user_id", "event_type")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return stream.tumbling(events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n_events FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
 FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, run""")
def events_sessions(spark, sf_dir):
    return stream.sessions(events(spark, sf_dir)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n_events")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def events_dedup(spark, sf_dir):
    rows = events(spark, sf_dir)
    return stream.without_repeats(rows.union(rows)).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


# Alerts ----------------------------------------------------------------------------------------------------------

_ALERTS = """WITH alerts AS (SELECT user_id % 40 AS cell, event_id AS ord, CASE event_type WHEN 'error' THEN 'Tornado Warning' WHEN 'click' THEN 'Flood Watch' WHEN 'signup' THEN 'Wind Advisory' WHEN 'view' THEN 'Special Weather Statement' ELSE 'Sale' END AS event,
 CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Severe' WHEN 2 THEN 'Minor' ELSE 'Odd' END AS severity FROM events)
, graded AS (SELECT *, CASE severity WHEN 'Extreme' THEN 4 WHEN 'Severe' THEN 3 WHEN 'Minor' THEN 1 ELSE 0 END * 10 + CASE event WHEN 'Tornado Warning' THEN 3 WHEN 'Flood Watch' THEN 2 WHEN 'Wind Advisory' THEN 1 ELSE 0 END AS grade FROM alerts WHERE event <> 'Sale')
, ranked AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY grade DESC, ord) AS rn, count(*) OVER (PARTITION BY cell) AS n_alerts, count(CASE WHEN event = 'Tornado Warning' THEN 1 END) OVER (PARTITION BY cell) AS n_travel FROM graded)
"""


def _alerts(spark, sf_dir):
    names = {"error": "Tornado Warning", "click": "Flood Watch", "signup": "Wind Advisory", "view": "Special Weather Statement"}
    event = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("event_type")), F.lit("Sale"))
    severity = F.element_at(F.array(*map(F.lit, ["Extreme", "Severe", "Minor", "Odd"])), (F.floor("value") % 4 + 1).cast("int"))
    rows = events(spark, sf_dir).select((F.col("user_id") % 40).alias("cell"), F.col("event_id").alias("ord"), event.alias("event"), severity.alias("severity"), "ts", "value")
    rows = rows.select("*", F.concat(F.lit("Alert "), F.col("ord").cast("string")).alias("headline"), F.when(F.col("value") > 50, "Stay inside.").alias("instruction"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires"))
    return metrics.worst_alert(rows, metrics.relevant_alerts(spark), "cell")


@query(_ALERTS + "SELECT cell, event, severity, grade, ord, n_alerts, n_travel FROM ranked WHERE rn = 1")
def worst_alert_per_cell(spark, sf_dir):
    return _alerts(spark, sf_dir).select("cell", "event", "severity", "grade", "ord", "n_alerts", "n_travel")


@query(_ALERTS + "SELECT r.cell, 'Alert ' || r.ord AS headline, CASE WHEN e.value > 50 THEN 'Stay inside.' END AS instruction, strftime(e.ts + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS expires FROM ranked r JOIN events e ON e.event_id = r.ord WHERE rn = 1")
def worst_alert_texts(spark, sf_dir):
    return _alerts(spark, sf_dir).select("cell", "headline", "instruction", F.date_format("expires", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query(_ALERTS + "SELECT c_custkey AS place, event FROM customer LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) ON cell = c_custkey % 50")
def alert_for_place(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), (F.col("c_custkey") % 50).alias("cell"))
    return metrics.alert_map(rows, _alerts(spark, sf_dir), "cell").select("place", F.get_json_object("alert", "$.event").alias("event"))


_EVENTS = [e for e, _, _ in metrics.RELEVANT_ALERTS] + ["Beach Hazards Statement", "Red Flag Warning"]


@query(
    "WITH shown AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{v}', {str(t).lower()})" for e, v, t in metrics.RELEVANT_ALERTS) + ") AS v(event, level, affects_travel))\n"
    f", told AS (SELECT event_id, ([{', '.join(repr(e) for e in _EVENTS)}])[event_id % {len(_EVENTS)} + 1] AS event FROM events)\n"
    "SELECT event, level, affects_travel, count(*) AS n FROM told JOIN shown USING (event) GROUP BY ALL"
)
def alerts_shown(spark, sf_dir):
    event = F.element_at(F.array(*map(F.lit, _EVENTS)), (F.col("event_id") % len(_EVENTS) + 1).cast("int"))
    told = events(spark, sf_dir).select(event.alias("event"))
    return told.join(F.broadcast(metrics.relevant_alerts(spark)), "event").groupBy("event", "level", "affects_travel").agg(F.count("*").alias("n"))  # 29 fixed rows


_CODES = [(0, "Clear sky"), (3, "Partly cloudy"), (48, "Foggy"), (55, "Drizzle"), (57, "Freezing drizzle"), (65, "Rain"), (67, "Freezing rain"), (75, "Snow")]


@query("SELECT event_id, CASE WHEN c = 0 THEN 'Clear sky' " + " ".join(f"WHEN c <= {b} THEN '{n}'" for b, n in _CODES[1:]) + " WHEN c = 77 THEN 'Snow grains' WHEN c <= 82 THEN 'Rain showers' WHEN c <= 86 THEN 'Snow showers' WHEN c = 95 THEN 'Thunderstorm' WHEN c <= 99 THEN 'Thunderstorm with hail' ELSE 'Unknown' END AS label, c > 3 AND c <= 99 AS adverse FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + event_id % 4 AS c FROM events)")
def weather_codes(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("w", metrics.weather_label(F.col("k") + F.col("event_id") % 4))
    return rows.select("event_id", F.col("w.label").alias("label"), F.col("w.adverse").alias("adverse"))


@query(WITH + "SELECT printf('%.2f', floor(place_lat * 100 + 0.5e0) / 100) || '_' || printf('%.2f', floor(place_lon * 100 + 0.5e0) / 100) AS cell, count(*) AS n FROM place GROUP BY 1")
def places_by_cell(spark, sf_dir):
    return places(spark, sf_dir).groupBy(cell_key(F.col("place_lat"), F.col("place_lon"), 2).alias("cell")).agg(F.count("*").alias("n"))


@query(WITH + "SELECT zip, count(*) AS n, count(DISTINCT source) AS n_sources FROM record GROUP BY zip")
def records_by_block(spark, sf_dir):
    return records(spark, sf_dir).groupBy("zip").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


# The driver's own tables, for the bench ---------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, count(*) AS n, round(avg(l_discount), 6) AS avg_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01' GROUP BY 1, 2")
def lineitem_load(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@query("SELECT n_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def orders_by_area(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "orders").join(customer, "o_custkey").join(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"))
