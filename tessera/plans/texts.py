"""Queries on strings: contact fields, names, addresses, tags and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import search
from tessera.plans.catalogue import query
from tessera.plans.domain import WITH, places, records
from tessera.plans.resolution import common_sql
from tessera.session import table


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '\+?1?[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}', 0), '') AS phone, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0), '') AS email FROM documents""")
def contact_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_phone(F.col("text")).alias("phone"), text.first_email(F.col("text")).alias("email"))


_SAID = "'Open Monday 9am - 5pm, Sat 10:00 am to 2 pm' || CASE place % 3 WHEN 0 THEN ' and Wed, 8 PM-10 PM.' WHEN 1 THEN '; closed Sunday.' ELSE '' END || ' See ' || CASE WHEN place % 4 > 0 THEN 'https://place.example/' || place || '?x=(1).' ELSE 'us.' END"


@query(WITH + rf"""SELECT place, array_to_string(regexp_extract_all(said, '{text.HOURS.replace(chr(92) + 'u2013', chr(0x2013))}'), '; ') AS hours, nullif(regexp_replace(regexp_extract(said, 'https?://[^\s)>"'']+'), '[.,;:!?]+$', ''), '') AS url FROM (SELECT place, {_SAID} AS said FROM place)""")
def hours_and_url_extract(spark, sf_dir):
    said = F.expr(_SAID.replace("|| place ||", "|| CAST(place AS STRING) ||"))
    return places(spark, sf_dir).select("place", text.all_hours(said).alias("hours"), text.first_url(said).alias("url"))


@query(WITH + "SELECT place, '(301) 555-' || CAST(1000 + place % 9000 AS STRING) AS phone FROM place WHERE phone IS NOT NULL")
def phone_normalize(spark, sf_dir):
    return places(spark, sf_dir).where("phone IS NOT NULL").select("place", text.phone(F.col("phone")).alias("phone"))


@query(WITH + "SELECT ord, 'org_' || source || '__' || substr(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS id FROM record")
def slug_id(spark, sf_dir):
    return records(spark, sf_dir).select("ord", text.record_id(F.col("source"), F.col("name")).alias("id"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '^http://', 'https://'), '^https://www\.', 'https://') AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("url"))


@query(WITH + "SELECT ord, 'Rockville' AS city, CAST(ord % 5 AS STRING) AS number, '20850' AS zip FROM record")
def city_infer(spark, sf_dir):
    rows = records(spark, sf_dir)
    return rows.select("ord", text.city_of(F.col("address")).alias("city"), text.street_number(F.col("address")).alias("number"), text.last_zip(F.col("address")).alias("zip"))


@query(WITH + "SELECT ord, plain_name AS name FROM record")
def clean_names(spark, sf_dir):
    return records(spark, sf_dir).select("ord", text.clean_name(F.col("name")).alias("name"))


_TAGS = [("licen[sc]e", "licence"), ("http", "link"), (r"\d{4}", "number"), ("all rights", "rights")]


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{t}' END" for p, t in _TAGS) + ") AS tags FROM documents")
def keyword_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tags_by_pattern(F.col("text"), _TAGS), ",").alias("tags"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'home' WHEN 'MACHINERY' THEN 'work' WHEN 'AUTOMOBILE' THEN 'work' ELSE '' END || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ',work' ELSE '' END AS tags FROM customer")
def list_tags(spark, sf_dir):
    listed = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat("c_mktsegment", F.lit(", MACHINERY, unknown, machinery"))).otherwise(F.col("c_mktsegment"))
    names = {"household": "home", "machin": "work", "auto": "work"}
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.tags_by_list(listed, names), ",").alias("tags"))


@query(WITH + "SELECT place, concat_ws(',', 'en', CASE WHEN speaks_es THEN 'es' END, CASE WHEN speaks_am THEN 'am' END, CASE WHEN speaks_fr THEN 'fr' END) AS codes FROM place")
def language_codes(spark, sf_dir):
    names = {"english": "en", "spanish": "es", "amharic": "am"}
    full = {"en": "English", "es": "Spanish", "am": "Amharic", "fr": "French"}
    spoken = F.transform("languages", lambda x: F.element_at(F.create_map(*[F.lit(v) for p in full.items() for v in p]), x))
    return places(spark, sf_dir).select("place", F.array_join(text.coded(spoken, names), ",").alias("codes"))


@query(WITH + "SELECT place, CASE main_service WHEN 'hot_meals' THEN 'meals' WHEN 'produce' THEN 'food_pantry' ELSE main_service END AS services FROM place")
def service_names(spark, sf_dir):
    listed = F.when(F.col("main_service") == "produce", F.array(F.lit("walk_in"))).otherwise(F.concat("services", F.array(F.lit("walk_in"))))
    rows = places(spark, sf_dir).select("place", listed.alias("s"))
    return rows.select("place", F.array_join(text.services_of(F.col("s"), {"hot_meals": "meals"}, ["walk_in", "no_id_required"]), ",").alias("services"))


@query(WITH + "SELECT place, CASE WHEN hero_copy IS NOT NULL THEN 'Open to all, come by' END AS hero_copy FROM place")
def tidy_text(spark, sf_dir):
    return places(spark, sf_dir).select("place", text.tidy(F.col("hero_copy")).alias("hero_copy"))


@query(WITH + "SELECT place, CASE WHEN speaks_es THEN 'Abierto' ELSE 'Open' END AS headline, 'Hi ' || place_name || ', ' || place || ' of 9' AS greeting FROM place")
def localize_text(spark, sf_dir):
    translations = F.when(F.col("speaks_es"), F.create_map(F.lit("es"), F.struct(F.lit("Abierto").alias("headline"))))
    rows = places(spark, sf_dir).withColumn("translations", translations)
    greeting = text.interpolated(F.lit("Hi {{name}}, {{n}} of 9"), name=F.col("place_name"), n=F.col("place"))
    return rows.select("place", text.localized(F.col("translations"), F.lit("es"), "headline", F.lit("Open")).alias("headline"), greeting.alias("greeting"))


@query(WITH + "SELECT ord, address || ', MD' AS full_address FROM (SELECT ord, CAST(ord % 5 AS STRING) || ' Main St, Rockville' AS address FROM record)")
def geocode_address(spark, sf_dir):
    rows = records(spark, sf_dir).select("ord", F.concat((F.col("ord") % 5).cast("string"), F.lit(" Main St, Rockville")).alias("address"))
    return rows.select("ord", text.full_address(F.col("address"), F.lit("rockville"), F.lit("MD"), F.lit("")).alias("full_address"))


@query("SELECT conv_id, string_agg(upper(role[1]) || length(text), ' | ' ORDER BY turn) AS shape, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_shape(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("part", F.concat(F.upper(F.substring("role", 1, 1)), F.length("text").cast("string")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"])
    return rows.groupBy("conv_id").agg(F.array_join(ordered, " | ").alias("shape"), F.count("*").alias("turns"))


_WANTED = "red widgit"


def _likeness_sql(field: str) -> str:
    part = f"array_to_string(have[k + 1:k + {len(_WANTED.split())}], ' ')"
    return f"(SELECT coalesce(max(2e0 * {common_sql(chr(39) + _WANTED + chr(39), 'part')} / (len(part) + {len(_WANTED)})), 0e0) FROM (SELECT {part} AS part FROM (SELECT unnest(range(0, greatest(1, len(have) - 1))) AS k, have FROM (SELECT list_filter(regexp_split_to_array(lower(v.{field}), '\\s+'), lambda x: x <> '') AS have)) WHERE len(have) > 0))"


_SEARCH = f"""WITH v AS (SELECT DISTINCT p_name, p_brand, p_type FROM part), scored AS (SELECT *, round(0e0 + {_likeness_sql('p_name')} * 0.6e0 + {_likeness_sql('p_brand')} * 0.2e0 + {_likeness_sql('p_type')} * 0.2e0, 6) AS score FROM v)
SELECT p_partkey, score FROM part JOIN scored USING (p_name, p_brand, p_type) WHERE score >= 0.4"""


@query(_SEARCH)
def fuzzy_search(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return search.search(rows, _WANTED, {"p_name": 0.6, "p_brand": 0.2, "p_type": 0.2}, "p_partkey")


@query(WITH + "SELECT ord, md5(source || chr(31) || plain_name) AS key FROM record")
def extraction_cache_key(spark, sf_dir):
    return records(spark, sf_dir).select("ord", text.cache_key(F.col("source"), F.col("plain_name")).alias("key"))
