"""Queries that resolve records of one place, and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo, text
from tessera.operators import lookup
from tessera.operators import resolution as op
from tessera.plans.catalogue import query
from tessera.plans.domain import WITH, places
from tessera.plans.domain import records as named_records
from tessera.session import table

#: Some records have no name, or nothing but marks.
_NAME = "CASE WHEN ord % 41 = 0 THEN ' ' WHEN ord % 43 = 0 THEN '., !' ELSE name END"
_PAIRS = WITH + f""", keyed AS (SELECT * FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({_NAME})), ', inc\\.$', ''), '[.,:;!?]', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM record WHERE length(zip) > 0) WHERE length(clean) > 0)
, pairs AS (SELECT a.ord AS a, b.ord AS b FROM keyed a JOIN keyed b ON a.zip = b.zip AND a.clean = b.clean AND a.ord < b.ord
  WHERE NOT (coalesce(length(a.hours) > 0, false) AND coalesce(length(b.hours) > 0, false) AND a.source = b.source))
"""
_GROUPS = _PAIRS.replace("WITH place", "WITH RECURSIVE place", 1) + """, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)
, reach AS (SELECT a AS ord, a AS seen FROM both_ways UNION SELECT r.ord, e.b FROM reach r JOIN both_ways e ON r.seen = e.a)
, groups AS (SELECT ord, min(seen) AS grp FROM reach GROUP BY ord)
, ranked AS (SELECT r.*, coalesce(g.grp, r.ord) AS grp,
   row_number() OVER (PARTITION BY coalesce(g.grp, r.ord) ORDER BY coalesce(length(hours) > 0, false) DESC, coalesce(length(hero_copy) > 0, false) DESC, speaks_es DESC,
   (CASE WHEN length(address) > 0 THEN 1 ELSE 0 END + CASE WHEN length(hours) > 0 THEN 1 ELSE 0 END + CASE WHEN length(phone) > 0 THEN 1 ELSE 0 END + CASE WHEN length(website) > 0 THEN 1 ELSE 0 END + CASE WHEN length(hero_copy) > 0 THEN 1 ELSE 0 END) DESC,
   CASE source WHEN 'mocofood' THEN 5 WHEN 'cafb' THEN 4 WHEN 'two11md' THEN 3 WHEN 'two11va' THEN 3 WHEN 'mdfb-find-food' THEN 2 ELSE 1 END DESC, r.ord) AS place FROM record r LEFT JOIN groups g ON r.ord = g.ord)
"""


def records(spark, sf_dir):
    return named_records(spark, sf_dir).withColumn("name", F.expr(_NAME))


@query(_PAIRS + "SELECT a, b FROM pairs")
def dedup_pairs_exact(spark, sf_dir):
    return op.pairs(records(spark, sf_dir), fuzzy=False).select("a", "b")


def common_sql(a: str, b: str) -> str:
    """SQL for the length of the longest common subsequence of two strings, ``a`` of at most 60 characters."""
    whole = f"((CAST(1 AS BIGINT) << len({a})) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda ch: CAST(coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {a}[i] = ch THEN CAST(1 AS BIGINT) << CAST(i - 1 AS BIGINT) ELSE 0 END)), 0) AS BIGINT))"
    return f"(len({a}) - bit_count(list_reduce(list_prepend({whole}, {masks}), lambda row, hit: ((row + (row & hit)) | (row - (row & hit))) & {whole})))"


_FUZZY = _PAIRS + f""", words AS (SELECT DISTINCT clean, array_to_string(list_sort(string_split(clean, ' ')), ' ') AS w FROM keyed)
, ratios AS MATERIALIZED (SELECT x.clean AS name_a, y.clean AS name_b, 200e0 * {common_sql('x.w', 'y.w')} / (len(x.w) + len(y.w)) AS ratio FROM words x JOIN words y ON x.clean <> y.clean)
SELECT a, b, 'name' AS rule FROM pairs UNION ALL SELECT l.ord, r.ord, CASE WHEN ratio >= 92 THEN 'likeness' ELSE 'street' END FROM keyed l JOIN keyed r ON l.zip = r.zip AND l.ord < r.ord JOIN ratios ON name_a = l.clean AND name_b = r.clean
 WHERE ratio >= 92 OR (ratio >= 80 AND l.ord % 5 = r.ord % 5)"""


@query(_FUZZY)
def dedup_pairs_fuzzy(spark, sf_dir):
    return op.pairs(records(spark, sf_dir))


_WITH_FUZZY, _ALL_PAIRS = _FUZZY.split("SELECT a, b, 'name'")


@query(_WITH_FUZZY.replace("WITH place", "WITH RECURSIVE place", 1) + ", alike AS (SELECT a, b, 'name'" + _ALL_PAIRS + """), both_ways AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike)
, reach AS (SELECT a AS ord, a AS seen FROM both_ways UNION SELECT r.ord, e.b FROM reach r JOIN both_ways e ON r.seen = e.a) SELECT ord, min(seen) AS grp FROM reach GROUP BY ord""")
def dedup_components_fuzzy(spark, sf_dir):
    return op.groups(op.links(records(spark, sf_dir))).withColumnRenamed("group", "grp")


@query(_PAIRS + """, stands AS (SELECT ord, zip, clean, CASE WHEN length(hours) > 0 THEN source END AS own FROM keyed)
, placed AS (SELECT *, min(ord) OVER w AS first, first_value(own) OVER w AS first_own FROM stands WINDOW w AS (PARTITION BY zip, clean ORDER BY ord))
, sided AS (SELECT *, coalesce(own = first_own, false) OR ord = first AS aside FROM placed)
, others AS (SELECT zip, clean, min(ord) AS other FROM sided WHERE NOT aside GROUP BY zip, clean)
SELECT first AS a, ord AS b FROM sided WHERE NOT aside UNION ALL SELECT other, ord FROM sided JOIN others USING (zip, clean) WHERE aside AND ord <> first""")
def dedup_links(spark, sf_dir):
    """A link for each record that has a match by name, whatever the number of equal names."""
    return op.links(records(spark, sf_dir), fuzzy=False)


def _ranked(spark, sf_dir):
    rows = records(spark, sf_dir)
    return op.ranked(rows, op.groups(op.links(rows, fuzzy=False)))


@query(_GROUPS + "SELECT ord, grp FROM groups")
def dedup_components(spark, sf_dir):
    return op.groups(op.links(records(spark, sf_dir), fuzzy=False)).withColumnRenamed("group", "grp")


@query(_GROUPS + "SELECT grp, ord AS survivor FROM ranked WHERE place = 1")
def dedup_survivor(spark, sf_dir):
    return _ranked(spark, sf_dir).where("place = 1").select(F.col("group").alias("grp"), F.col("ord").alias("survivor"))


def _merged(spark, sf_dir):
    return op.merge(_ranked(spark, sf_dir), ["address", "phone", "website", "hours"], ["languages"], ["accepts_food"])


@query(_GROUPS + """SELECT grp, arg_min(phone, place) FILTER (WHERE length(trim(phone)) > 0) AS phone, arg_min(website, place) FILTER (WHERE length(trim(website)) > 0) AS website,
 arg_min(hours, place) FILTER (WHERE length(trim(hours)) > 0) AS hours, bool_or(accepts_food) AS accepts_food, count(*) AS n_records FROM ranked GROUP BY grp""")
def dedup_backfill(spark, sf_dir):
    return _merged(spark, sf_dir).select(F.col("group").alias("grp"), "phone", "website", "hours", "accepts_food", "n_records")


@query(_GROUPS + """, tags AS (SELECT grp, place, CASE WHEN is_walk_in THEN 'walk_in' WHEN is_appointment THEN 'appointment_required' END AS tag FROM ranked)
 SELECT grp, coalesce(arg_min(tag, place) FILTER (WHERE tag IS NOT NULL), '') AS requirements FROM tags GROUP BY grp""")
def dedup_tag_union(spark, sf_dir):
    return _merged(spark, sf_dir).select(F.col("group").alias("grp"), F.array_join("requirements", ",").alias("requirements"))


@query(_GROUPS + """SELECT grp, concat_ws('; ', CASE WHEN count(DISTINCT CASE WHEN length(trim(hours)) > 0 THEN hours END) > 1 THEN 'hours differ between sources' END,
 CASE WHEN bool_or(is_walk_in) AND bool_or(is_appointment) THEN 'walk-in and appointment both reported' END) AS warnings FROM ranked GROUP BY grp""")
def dedup_warnings(spark, sf_dir):
    return _merged(spark, sf_dir).select(F.col("group").alias("grp"), F.array_join("warnings", "; ").alias("warnings"))


@query(_GROUPS + """, firsts AS (SELECT grp, source, min(place) AS place FROM ranked GROUP BY grp, source) SELECT grp, string_agg(source, ',' ORDER BY place) AS source_ids, count(*) AS cross_source_count FROM firsts GROUP BY grp""")
def dedup_sources(spark, sf_dir):
    return _merged(spark, sf_dir).select(F.col("group").alias("grp"), F.array_join("source_ids", ",").alias("source_ids"), F.col("cross_source_count").cast("long").alias("cross_source_count"))


@query(_GROUPS + "SELECT grp, CASE WHEN ord % 3 = 0 THEN 'step 1,step 2,step 3' WHEN ord % 3 = 1 THEN 'ask' ELSE '' END AS guide FROM ranked WHERE place = 1")
def dedup_guide(spark, sf_dir):
    """A merged record has its survivor's guide, three steps of it at most, and no other record's."""
    steps = F.when(F.col("ord") % 3 == 0, F.array(*[F.lit(f"step {k}") for k in range(1, 5)])).when(F.col("ord") % 3 == 1, F.array(F.lit("ask"))).otherwise(F.array().cast("array<string>"))
    merged = op.merge(_ranked(spark, sf_dir).withColumn("guide", steps), ["address"], ["languages"], ["accepts_food"])
    return merged.select(F.col("group").alias("grp"), F.array_join("guide", ",").alias("guide"))


@query(_GROUPS + "SELECT grp, count(*) AS n_records FROM groups GROUP BY grp ORDER BY n_records DESC, grp LIMIT 15")
def dedup_dry_run(spark, sf_dir):
    return op.largest_groups(op.groups(op.links(records(spark, sf_dir), fuzzy=False))).withColumnRenamed("group", "grp")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def first_by_name(spark, sf_dir):
    return op.first_by(table(spark, sf_dir, "part"), ["p_name"], "p_partkey").select("p_name", "p_partkey", "p_brand")


# Lookups ---------------------------------------------------------------------------------------------------------

_GEO = WITH + """, gaz AS (SELECT lower(trim(s_name)) AS nk, s_suppkey FROM supplier)
, wanted AS (SELECT place, CASE WHEN place % 5 = 0 THEN place_lat END AS lat, CASE WHEN place % 5 = 0 THEN place_lon END AS lon, 'supplier#' || lpad(CAST(place % 150 AS STRING), 9, '0') AS nk, CAST(place % 40 AS STRING) || ' elm' AS ak, area FROM place)
, names AS (SELECT nk, arg_max(lat, s_suppkey) AS n_lat, arg_max(lon, s_suppkey) AS n_lon FROM (SELECT nk, s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 10e0 ELSE 39e0 END AS lat, -77e0 AS lon FROM gaz) GROUP BY nk)
, addresses AS (SELECT CAST(n_nationkey AS STRING) || ' elm' AS ak, CASE WHEN n_nationkey % 3 > 0 THEN 38.9e0 END AS a_lat, CASE WHEN n_nationkey % 3 > 0 THEN -77.1e0 END AS a_lon, true AS cached FROM nation)
SELECT place, CASE WHEN w.lat IS NOT NULL THEN 'existing' WHEN coalesce(n_lat BETWEEN 37.5 AND 40.0, false) THEN 'name' WHEN a_lat IS NOT NULL THEN 'address' WHEN area.lat IS NOT NULL THEN 'zip_centroid' ELSE 'none' END AS geocode_method,
 CASE WHEN w.lat IS NOT NULL THEN w.lat WHEN coalesce(n_lat BETWEEN 37.5 AND 40.0, false) THEN n_lat WHEN a_lat IS NOT NULL THEN a_lat ELSE area.lat END AS lat,
 CASE WHEN cached IS NULL THEN 'miss' WHEN a_lat IS NULL THEN 'negative' ELSE 'hit' END AS cache_state
FROM wanted w LEFT JOIN names USING (nk) LEFT JOIN addresses USING (ak) LEFT JOIN area ON area.area = w.area AND w.area % 4 > 0
"""


def _geocoded(spark, sf_dir):
    rows = places(spark, sf_dir)
    wanted = rows.select(
        "place",
        F.when(F.col("place") % 5 == 0, F.col("place_lat")).alias("lat"),
        F.when(F.col("place") % 5 == 0, F.col("place_lon")).alias("lon"),
        F.concat(F.lit(" Supplier#"), F.lpad((F.col("place") % 150).cast("string"), 9, "0")).alias("name"),
        F.concat((F.col("place") % 40).cast("string"), F.lit(" Elm ")).alias("address"),
        F.col("area").alias("zip"),
    )
    by_name = table(spark, sf_dir, "supplier").select(F.lower(F.trim("s_name")).alias("name_key"), F.when(F.col("s_suppkey") % 10 == 0, 10.0).otherwise(39.0).alias("n_lat"), F.lit(-77.0).alias("n_lon"), F.col("s_suppkey").alias("ord"))
    nation = table(spark, sf_dir, "nation")
    known = F.col("n_nationkey") % 3 > 0
    by_address = nation.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(" elm")).alias("address_key"), F.when(known, 38.9).alias("a_lat"), F.when(known, -77.1).alias("a_lon"))
    centroids = nation.where("n_nationkey % 4 > 0").selectExpr("n_nationkey AS zip", "38.5e0 + ((n_nationkey * 41) % 100) / 100e0 AS z_lat", "-77.5e0 + ((n_nationkey * 17) % 100) / 100e0 AS z_lon")
    return lookup.geocode(wanted, by_name, by_address, centroids)


@query(_GEO)
def geocode_tiers(spark, sf_dir):
    return _geocoded(spark, sf_dir).select("place", "geocode_method", "lat", "cache_state")


@query("SELECT geocode_method, count(*) AS n FROM (" + _GEO + ") GROUP BY geocode_method")
def geocode_stats(spark, sf_dir):
    return _geocoded(spark, sf_dir).groupBy("geocode_method").agg(F.count("*").alias("n"))


@query(WITH + "SELECT place, zip, CASE WHEN CAST(zip AS INT) BETWEEN 20001 AND 20099 OR CAST(zip AS INT) BETWEEN 20200 AND 20599 THEN 'DC' WHEN CAST(zip AS INT) BETWEEN 20600 AND 21999 THEN 'MD' WHEN CAST(zip AS INT) BETWEEN 22000 AND 24699 OR CAST(zip AS INT) BETWEEN 20100 AND 20199 THEN 'VA' END AS state FROM place")
def state_from_zip(spark, sf_dir):
    return places(spark, sf_dir).select("place", "zip", text.state_of_zip(F.col("zip")).alias("state"))


@query(WITH + "SELECT place, CASE zip WHEN '20198' THEN 'am' ELSE CASE substr(zip, 1, 3) WHEN '200' THEN 'es' WHEN '207' THEN 'fr' END END AS lang FROM place")
def zip_prefix_language(spark, sf_dir):
    known = spark.createDataFrame([("20198", "am"), ("200", "es"), ("207", "fr")], "key string, value string")
    return lookup.by_prefix(places(spark, sf_dir).select("place", "zip"), known, "zip", "lang").select("place", "lang")


@query("SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'miss' WHEN date_diff('second', last, TIMESTAMP '1999-06-01') < 7776000 THEN 'hit' ELSE 'stale' END AS cache_state FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def cache_hit_miss(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("fetched"))
    return lookup.with_cache(table(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey", "fetched", F.lit("1999-06-01 00:00:00"), 90 * 86400).select("c_custkey", "cache_state")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def cache_todo_anti(spark, sf_dir):
    cache = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return lookup.todo(table(spark, sf_dir, "part").select("p_partkey"), cache, "p_partkey")


@query(WITH + ", keyed AS (SELECT place, printf('%.2f', floor(place_lat * 100 + 0.5e0) / 100) || '_' || printf('%.2f', floor(place_lon * 100 + 0.5e0) / 100) AS cell, balance FROM place) SELECT place, cell, first_value(balance) OVER (PARTITION BY cell ORDER BY place) AS shared FROM keyed")
def cell_shared_result(spark, sf_dir):
    rows = places(spark, sf_dir).select("place", "place_lat", "place_lon", F.col("balance").alias("shared"))
    key = geo.cell_key(F.col("place_lat"), F.col("place_lon"), 2)
    return lookup.shared_by_first(rows, key, "place", ["shared"]).select("place", geo.cell_key(F.col("place_lat"), F.col("place_lon"), 2).alias("cell"), "shared")


@query(WITH + ", pages AS (SELECT 'https://place' || CAST(s_suppkey % 700 AS STRING) || '.example.org' AS u, min(s_name) AS found FROM supplier GROUP BY 1) SELECT place, CASE WHEN length(hours) > 0 THEN hours ELSE found END AS hours FROM place LEFT JOIN pages ON u = replace(regexp_replace(regexp_replace(lower(trim(website)), '/+$', ''), '^http://', 'https://'), 'https://www.', 'https://')")
def enrich_by_website(spark, sf_dir):
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.lit("HTTPS://WWW.place"), (F.col("s_suppkey") % 700).cast("string"), F.lit(".example.org//")).alias("url"), F.col("s_name").alias("hours"))
    return lookup.enrich_by_url(places(spark, sf_dir).select("place", "website", "hours"), pages, text.url_key(F.col("website")), text.url_key(F.col("url")), "hours").select("place", "hours")
