"""Queries on enrichment and the export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import enrichment, export
from tessera.plans.catalogue import query
from tessera.plans.domain import WITH, areas, places
from tessera.session import shared_folder, table
from tessera.sources import external, files

@query(WITH + """SELECT place, CASE WHEN is_walk_in AND is_no_id THEN CASE place % 2 WHEN 0 THEN 'Walk in, no papers asked.' ELSE 'Come by any open day without papers.' END
 WHEN is_walk_in THEN CASE place % 2 WHEN 0 THEN 'Walk in during open hours.' ELSE 'No appointment, just come by.' END WHEN main_service = 'delivery' THEN 'Food brought to your door.'
 WHEN main_service = 'hot_meals' THEN 'Warm meals, served on site.' WHEN main_service = 'mobile_pantry' THEN 'A pantry that comes to your street.'
 ELSE CASE place % 2 WHEN 0 THEN 'Groceries for people nearby.' ELSE 'Food help for the neighbourhood.' END END AS hero,
 CASE WHEN is_no_id THEN 'No ID or papers are needed.' WHEN is_photo_id AND is_proof THEN 'Bring a photo ID and proof of address.' WHEN is_photo_id THEN 'Bring a photo ID.' WHEN is_income THEN 'You may be asked about income.' ELSE 'Call ahead to hear what to bring.' END AS eligibility,
 CASE WHEN is_walk_in AND is_no_id THEN 0.9e0 WHEN is_walk_in THEN 0.7e0 WHEN is_appointment THEN 0.45e0 ELSE 0.6e0 END AS tone FROM place""")
def template_copy(spark, sf_dir):
    r = F.col("requirements")
    return places(spark, sf_dir).select("place", enrichment.template_hero(F.col("services"), r, F.col("place")).alias("hero"), enrichment.template_eligibility(r).alias("eligibility"), enrichment.template_tone(r).alias("tone"))


@query(WITH + """SELECT place, CASE WHEN is_walk_in THEN 'Walk in during open hours.' WHEN is_appointment THEN 'Call ahead for an appointment.' ELSE 'Check the hours before you come.' END || ' ' ||
 CASE WHEN is_no_id THEN 'Leave your papers at home.' WHEN is_photo_id AND is_proof THEN 'Bring a photo ID and proof of address.' WHEN is_photo_id THEN 'Bring a photo ID.' ELSE 'Bring an ID if you have one.' END || ' Bring bags to carry food home.' AS guide FROM place""")
def first_visit_guide(spark, sf_dir):
    return places(spark, sf_dir).select("place", F.array_join(enrichment.template_guide(F.col("requirements")), " ").alias("guide"))


@query("SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN 'appointment_required' END, CASE WHEN s_suppkey % 3 = 0 THEN 'walk_in' END, CASE WHEN s_suppkey % 5 = 0 THEN 'proof_of_address' END, CASE WHEN s_suppkey % 4 < 2 THEN 'photo_id' END, CASE WHEN s_suppkey % 4 = 1 THEN 'no_id_required' END) AS tags, CASE WHEN s_suppkey % 4 = 3 THEN 'Spanish,Korean' ELSE '' END AS languages FROM supplier")
def tags_from_days(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    notes = F.when(k % 4 == 0, "Bring ID").when(k % 4 == 1, "no ID asked").when(k % 4 == 3, "Espanol, Korean")
    tags = enrichment.requirements_from_days([F.when(k % 2 == 0, "Yes"), F.when(k % 3 == 0, "no")], [F.when(k % 5 == 0, "YES")], [F.lit(None).cast("string"), notes])
    return rows.select("s_suppkey", F.array_join(tags, ",").alias("tags"), F.array_join(enrichment.languages_from_notes(notes), ",").alias("languages"))


@query(WITH + "SELECT place, CASE place % 4 WHEN 0 THEN 'Rooted in the sikh community.' WHEN 1 THEN 'Several languages: Spanish, Amharic.' WHEN 2 THEN 'French is spoken.' END AS note FROM place")
def cultural_notes(spark, sf_dir):
    k = F.col("place") % 4
    name = F.when(k == 0, "Sikh Langar").otherwise("Hub")
    spoken = F.when(k == 1, F.array(*map(F.lit, ["English", "Spanish", "Amharic"]))).when(k == 2, F.array(*map(F.lit, ["French"]))).when(k == 3, F.array(F.lit("Spanish")))
    return places(spark, sf_dir).select("place", enrichment.cultural_note(name, spoken).alias("note"))


@query(WITH + """SELECT place, CASE WHEN tone < 0.99 AND tone > 0.01 THEN tone END AS tone, CASE WHEN place % 3 = 0 THEN NULL WHEN hero_copy IS NOT NULL THEN hero_copy END AS hero_copy, CASE WHEN length(hours) > 0 AND place % 2 = 1 THEN hours END AS hours, CASE WHEN place % 5 = 0 THEN 'https://give.org' END AS donate_url FROM place""")
def checked_results(spark, sf_dir):
    k = F.col("place")
    rows = places(spark, sf_dir).select(
        "place", "tone", F.when(k % 3 == 0, "Nourishing all").otherwise(F.col("hero_copy")).alias("hero_copy"), "hours",
        F.lit("https://give.org").alias("donate_url"), F.lit(None).cast("string").alias("volunteer_url"), F.lit("n/a").alias("eligibility"), F.array(F.lit("x" * 101)).alias("guide"),
        F.concat_ws(" ", F.when(k % 2 == 1, F.col("hours")), F.when(k % 5 == 0, "see https://give.org")).alias("combined_text"),
    )
    return enrichment.checked(rows).select("place", "tone", "hero_copy", "hours", "donate_url")


@query(WITH + "SELECT place, CASE WHEN length(hours) > 0 THEN hours WHEN place % 4 = 0 THEN 'Daily' ELSE hours END AS hours, main_service || CASE WHEN place % 4 = 0 AND main_service <> 'produce' THEN ',produce' ELSE '' END AS services, accepts_food OR place % 4 = 0 AS accepts_food FROM place")
def merged_results(spark, sf_dir):
    rows = places(spark, sf_dir).select("place", "hours", "services", "hero_copy", "accepts_food", "website")
    found = rows.where("place % 4 = 0").select("place", F.lit("Daily").alias("hours"), F.array(F.lit("produce")).alias("services"), F.lit(None).cast("string").alias("hero_copy"), F.lit(True).alias("accepts_food"), F.lit("").alias("website"))
    out = enrichment.merge_results(rows, found, "place", ["services"], ["hero_copy"], ["accepts_food"], ["website"])
    return out.select("place", "hours", F.array_join("services", ",").alias("services"), "accepts_food")


@query(WITH + "SELECT place, CASE WHEN main_service = 'food_pantry' THEN 'canned_goods' END AS food_types, CASE WHEN length(website) > 0 THEN website WHEN source = 'cafb' THEN 'https://www.capitalareafoodbank.org/find-food/' END AS website, CASE WHEN hero_copy IS NOT NULL THEN 'model' ELSE 'template' END AS extracted_by FROM place")
def record_defaults(spark, sf_dir):
    rows = places(spark, sf_dir).withColumn("food_types", F.lit(None).cast("array<string>")).withColumn("extracted_by", F.lit(""))
    return enrichment.defaults(rows).select("place", F.array_join("food_types", ",").alias("food_types"), "website", "extracted_by")


def _records(spark, sf_dir):
    k = F.col("place")
    metro = F.when(k % 3 > 0, F.struct(F.lit("Fort Totten").alias("name"), F.array(F.lit("RD"), F.lit("GR")).alias("lines"), F.lit(7.5).alias("walk_minutes"), F.lit(600.0).alias("metres")))
    bus = F.when(k % 4 > 1, F.struct(F.lit("70").alias("route"), F.lit(3.0).alias("walk_minutes"), F.lit(None).cast("double").alias("metres")))
    alert = F.when(k % 10 == 0, F.struct(F.lit("Flood Watch").alias("event"), F.lit("Minor").alias("severity"), F.lit("watch").alias("level"), F.lit(False).alias("affects_travel")))
    rows = places(spark, sf_dir).withColumns({"id": k, "name": F.col("place_name"), "address": F.when(k % 9 > 0, "1 Main St"), "state": F.when(k % 2 == 0, " md ").otherwise("Ohio"), "lat": F.when(k % 8 > 0, F.col("place_lat")).otherwise(0.0), "lon": F.col("place_lon")})
    return rows.withColumns({"metro": metro, "bus": bus, "alert": alert, "mode": F.when(k % 3 > 0, "metro").when(k % 4 > 1, "bus"), "guide": F.array().cast("array<string>"), "eligibility": F.lit(None).cast("string"), "trust": F.lit(0.9), "tier": F.lit("fresh")})


@query(WITH + """SELECT place AS id, CASE WHEN place % 2 = 0 THEN 'MD' ELSE 'Ohio' END AS state, CASE WHEN place % 3 > 0 AND place % 4 > 1 THEN '7.5-min walk to Fort Totten (RD/GR line); 3.0-min walk to Route 70 bus' WHEN place % 3 > 0 THEN '7.5-min walk to Fort Totten (RD/GR line)' WHEN place % 4 > 1 THEN '3.0-min walk to Route 70 bus' END AS summary,
 CASE WHEN place % 3 > 0 THEN 'Fort Totten' WHEN place % 4 > 1 THEN '70' END AS stop, CASE WHEN place % 3 > 0 THEN 600e0 WHEN place % 4 > 1 THEN 0e0 END AS metres, CASE WHEN place % 10 = 0 THEN 'watch' END AS alert FROM place WHERE place % 9 > 0 AND place % 8 > 0""")
def export_records(spark, sf_dir):
    return export.exported(_records(spark, sf_dir)).select("id", "state", F.col("transit.transitSummary").alias("summary"), F.col("nearestTransit.name").alias("stop"), F.col("nearestTransit.distanceMeters").alias("metres"), F.col("weather.alertLevel").alias("alert"))


_NEAR = "CASE WHEN place % 3 > 0 THEN 'metro' WHEN place % 4 > 1 THEN 'bus' END"
_WHOLE = WITH + f""", zips AS (SELECT CAST(20001 + (area * 197) % 4600 AS STRING) AS zip, label AS neighborhood, poverty / 4 AS gap FROM area WHERE area % 5 > 0)
, shown AS (SELECT *, {_NEAR} AS mode FROM place LEFT JOIN zips USING (zip) WHERE place % 9 > 0 AND place % 8 > 0)
"""


def _whole(spark, sf_dir):
    k = F.col("place")
    zips = areas(spark, sf_dir).where("area % 5 > 0").selectExpr("CAST(20001 + (area * 197) % 4600 AS STRING) AS zip", "label AS neighborhood", "poverty / 4 AS gap")
    given = {
        "city": F.when(k % 2 == 0, "Rockville"),
        "food_types": F.when(k % 4 == 1, F.array(F.lit("produce"), F.lit("dairy"))),
        "source_ids": F.when(k % 6 == 0, F.array(F.col("source"), F.lit("other"))),
        "source": F.when(k % 13 == 0, "county").when(k % 17 > 0, F.col("source")),
        "donate_url": F.when(k % 5 == 0, F.concat(F.lit("https://give.example/"), k.cast("string"))),
        "volunteer_url": F.when(k % 7 == 0, "https://help.example/"),
    }
    return export.whole(_records(spark, sf_dir).withColumns(given), zips, F.lit("2024-05-01T00:00:00Z"))


_SOURCE = "coalesce(CASE WHEN place % 13 = 0 THEN 'county' WHEN place % 17 > 0 THEN source END, 'unknown')"


@query(_WHOLE + f"""SELECT place AS id, neighborhood, CASE WHEN place % 2 = 0 THEN 'Rockville' ELSE '' END AS city, CASE WHEN place % 4 = 1 THEN 'produce,dairy' ELSE '' END AS food_types, mode AS transit_type,
 CASE mode WHEN 'metro' THEN 'RD,GR' WHEN 'bus' THEN '70' END AS transit_lines, CASE WHEN mode = 'metro' THEN 600e0 END AS transit_metres, CASE WHEN place % 10 = 0 THEN 'watch' END AS alert, {_SOURCE} AS source_id,
 CASE {_SOURCE} WHEN 'cafb' THEN 'Capital Area Food Bank' WHEN 'mdfb-find-food' THEN 'Maryland Food Bank' WHEN 'two11md' THEN '211 Maryland' WHEN 'two11va' THEN '211 Virginia' WHEN 'mocofood' THEN 'Montgomery County Food Council' ELSE {_SOURCE} END AS source_name,
 CASE WHEN place % 6 = 0 THEN source || ',other' ELSE {_SOURCE} END AS source_ids, CASE WHEN place % 6 = 0 THEN 2 ELSE 1 END AS n_sources, accepts_food, accepts_money, accepts_volunteers, CASE WHEN place % 5 = 0 THEN 'https://give.example/' || place END AS donate_url,
 CASE WHEN place % 7 = 0 THEN 'https://help.example/' END AS volunteer_url, CASE WHEN gap > 0.01 THEN CASE WHEN gap >= 0.06 THEN 'high' WHEN gap >= 0.03 THEN 'medium' ELSE 'low' END END AS urgency, CASE WHEN gap > 0.01 THEN round(gap / 0.03, 1) END AS multiplier, '2024-05-01T00:00:00Z' AS created_at, '2024-05-01T00:00:00Z' AS updated_at FROM shown""")
def exported_whole(spark, sf_dir):
    """Every field that ``export_records`` doesn't show, flat."""
    listed = {n: F.array_join(c, ",").alias(n) for n, c in (("food_types", "foodTypes"), ("transit_lines", "nearestTransitLines"), ("source_ids", "sourceIds"))}
    named = {"transit_type": "nearestTransitType", "transit_metres": "transitDistanceMeters", "alert": "weatherAlert.alertLevel", "source_id": "sourceId", "source_name": "sourceName", "n_sources": "crossSourceCount", "accepts_food": "acceptsFoodDonations", "accepts_money": "acceptsMoneyDonations", "accepts_volunteers": "acceptsVolunteers", "donate_url": "donateUrl", "volunteer_url": "volunteerUrl", "urgency": "urgency.level", "multiplier": "urgency.multiplier", "created_at": "createdAt", "updated_at": "updatedAt"}
    return _whole(spark, sf_dir).select("id", "neighborhood", "city", *listed.values(), *[F.col(c).alias(n) for n, c in named.items()])


_STATE = "CASE WHEN place % 2 = 0 THEN 'MD' ELSE 'other' END"


@query(_WHOLE + f"""SELECT 'total' AS kind, 'organizations' AS name, count(*) AS n FROM shown UNION ALL SELECT 'byState', s, count(*) FILTER (WHERE {_STATE} = s) FROM shown, (VALUES ('MD'), ('VA'), ('DC'), ('other')) AS v(s) GROUP BY s
 UNION ALL SELECT 'bySource', s, count(*) FILTER (WHERE CASE WHEN {_SOURCE} IN ('county', 'unknown') THEN 'other' ELSE {_SOURCE} END = s) FROM shown, (VALUES ('cafb'), ('mdfb-find-food'), ('two11md'), ('two11va'), ('mocofood'), ('other')) AS v(s) GROUP BY s
 UNION ALL SELECT 'coverage', c, count(*) FILTER (WHERE CASE c WHEN 'hours' THEN coalesce(length(hours) > 0, false) WHEN 'coords' THEN true WHEN 'heroCopy' THEN hero_copy IS NOT NULL WHEN 'website' THEN website IS NOT NULL WHEN 'foodTypes' THEN place % 4 = 1 WHEN 'languages' THEN true
  WHEN 'transit' THEN mode IS NOT NULL WHEN 'metro' THEN place % 3 > 0 WHEN 'bus' THEN place % 4 > 1 ELSE place % 10 = 0 END) FROM shown, (VALUES ('hours'), ('coords'), ('heroCopy'), ('website'), ('foodTypes'), ('languages'), ('transit'), ('metro'), ('bus'), ('weatherAlerts')) AS v(c) GROUP BY c""")
def export_file_metadata(spark, sf_dir):
    """The metadata that was observed while the export was written."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    export.write_export(_whole(spark, sf_dir), path)
    return export.read_metadata(spark, path)


@query(WITH + "SELECT place, place_name || chr(10) || '1 Main St' || CASE WHEN phone IS NOT NULL THEN chr(10) || phone ELSE '' END || CASE WHEN length(hours) > 0 THEN chr(10) || hours ELSE '' END AS text FROM place")
def share_texts(spark, sf_dir):
    return places(spark, sf_dir).select("place", export.share_text(F.col("place_name"), F.lit("1 Main St"), F.col("phone"), F.col("hours")).alias("text"))


@query(WITH + "SELECT area, label FROM area")
def feature_export(spark, sf_dir):
    features = files.as_features(areas(spark, sf_dir), "lat", "lon", ["area", "label"])
    return features.select(F.get_json_object("feature", "$.properties.area").cast("int").alias("area"), F.get_json_object("feature", "$.properties.label").alias("label"))


@query(WITH + "SELECT '{' || string_agg('\"' || area || '\":\"' || label || '\"', ',' ORDER BY area) || '}' AS document FROM area")
def area_names_document(spark, sf_dir):
    """One document of the areas' names, of which there is a set number."""
    return files.as_map_document(areas(spark, sf_dir).orderBy("area").coalesce(1), "area", "label")


@query(WITH + "SELECT place, CASE WHEN length(hours) = 0 OR hours IS NULL THEN NULL ELSE place % 4 < 2 OR NOT regexp_matches(hours, '[0-9]') END AS told FROM place")
def hours_are_in_text(spark, sf_dir):
    """Whether the numbers of a record's hours stand in the text that they are said to be of; here every other two of four have none."""
    source = F.when(F.col("place") % 4 < 2, F.concat(F.lit("We are open "), F.upper("hours"))).otherwise("We are open at times.")
    return places(spark, sf_dir).select("place", F.when(F.length("hours") > 0, text.occurs_in(F.col("hours"), source)).alias("told"))


@query("SELECT item_id, text AS translated, 'ok' AS status FROM benchmark")
def translation_hook(spark, sf_dir):
    return external.enrich(table(spark, sf_dir, "benchmark"), external.untranslated, "translated string").select("item_id", "translated", "status")
