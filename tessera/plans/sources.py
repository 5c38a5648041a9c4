"""Queries on sources: pages, unions and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.plans.catalogue import query
from tessera.plans.domain import WITH, places, records
from tessera.session import table
from tessera.sources import files, pages, sites


@query()
def page_records(spark, sf_dir):
    return pages.page_records(table(spark, sf_dir, "pages"))


#: Each site's own limits: elements beside a heading, letters of a name, a heading that is none, and what words tell.
_SITES = {"net": (2, 3, 150, "no such heading", {"the": "services:hot_meals"}), "com": (4, 3, 60, "Thing.", {"que": "requirements:walk_in", "ing": "services:delivery"}), "org": (1, 10, 80, "Inouin of on.", {"erea|oua": "food_types:produce"})}
_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))"


def _tags(column: str) -> str:
    """SQL for the tags of a column, in the order of the taxonomy."""
    told = [f"CASE WHEN site = '{s}' AND regexp_matches(text, '(?i){p}') THEN '{t.partition(':')[2]}' END" for s, rule in _SITES.items() for p, t in rule[4].items() if t.startswith(column)]
    return f"concat_ws(',', {', '.join(told)})"


@query(rf"""WITH rules AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {n}, {least}, {most}, '{no.lower()}')" for s, (n, least, most, no, _) in _SITES.items())}) AS r(site, siblings, least, most, rejected))
, parts AS (SELECT page_id, regexp_extract(url, '://[^/?#]*\.([a-z]+)[/?#:]', 1) AS site, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h, string_split(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<p>')[2:] AS ps FROM pages)
, named AS (SELECT page_id, site, {_CLEAN.format('h')} AS name, concat_ws(' ', nullif({_CLEAN.format('h')}, ''), nullif(array_to_string(list_filter(list_transform(ps[1:siblings], lambda x: {_CLEAN.format('x')}), lambda x: x <> ''), ' '), '')) AS text, least, most, rejected FROM parts JOIN rules USING (site))
SELECT page_id, site, name, md5(text) AS text_md5, {_tags('services')} AS services, {_tags('requirements')} AS requirements, {_tags('food_types')} AS food_types FROM named WHERE length(name) BETWEEN least AND most AND lower(name) <> rejected""")
def site_records(spark, sf_dir):
    """The records of all pages, each site's by a row of rules of its own."""
    rows = [(s, "heading", ["article", "body"], ["h1", "h2", "h3"], n, least, most, [no], None, None, taxonomy) for s, (n, least, most, no, taxonomy) in _SITES.items()]
    rules = spark.createDataFrame(rows, sites.RULES)
    found = sites.site_records(table(spark, sf_dir, "pages"), rules, F.regexp_extract("url", r"://[^/?#]*\.([a-z]+)[/?#:]", 1))
    return found.select("page_id", "site", "name", F.md5("text").alias("text_md5"), *[F.array_join(c, ",").alias(c) for c in ("services", "requirements", "food_types")])


_CHAIN = """WITH told AS (SELECT o_custkey % 7 AS site, 1 + o_orderkey % 12 AS page, CAST(floor(o_totalprice) AS BIGINT) % 300 AS name, o_orderkey FROM orders)
, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, name ORDER BY page, o_orderkey) AS rn FROM told WHERE page <= 10) WHERE rn = 1)
, stop AS (SELECT s.site, min(p.page) AS stop FROM (SELECT DISTINCT site FROM told) s CROSS JOIN (SELECT unnest(range(1, 12)) AS page) p WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.site = s.site AND f.page = p.page) GROUP BY s.site)
SELECT site, page, name, o_orderkey FROM first JOIN stop USING (site) WHERE page < stop"""


@query(_CHAIN)
def page_chain(spark, sf_dir):
    told = table(spark, sf_dir, "orders").selectExpr("o_custkey % 7 AS site", "1 + o_orderkey % 12 AS page", "CAST(floor(o_totalprice) AS BIGINT) % 300 AS name", "o_orderkey")
    return pages.page_chain(told, "site", "page", "name", "o_orderkey", 10)


_CARD = "'<div class=\"card\"><p data-name=\"kind\"><b>' || CASE p_size % 3 WHEN 0 THEN 'None' ELSE p_brand END || '</b>  ' || p_type || '</p><p data-name=\"site\"><a href=\"' || CASE p_size % 2 WHEN 0 THEN 'https://a.example/' || p_size ELSE '/local' END || '\">x</a></p></div>'"


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'None' ELSE p_brand END || ' ' || p_type AS kind, CASE WHEN p_size % 2 = 0 THEN 'https://a.example/' || p_size END AS site, p_size % 4 < 2 AS near FROM part")
def tagged_cards(spark, sf_dir):
    near = pages.in_states(F.expr("'1 Elm St, Town, ' || element_at(array('MD', 'VA', 'PA', 'NY'), CAST(p_size % 4 + 1 AS INT)) || ' 20850'"), ["MD", "DC", "VA"])
    cards = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CARD).alias("card"), near.alias("near"))
    return cards.select("p_partkey", pages.tagged_field(F.col("card"), "kind").alias("kind"), pages.tagged_link(F.col("card"), "site").alias("site"), "near")


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS n_links FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.title(F.col("html")).alias("title"), F.size(pages.links(F.col("html"))).cast("long").alias("n_links"))


@query(WITH + "SELECT place AS id, source, 'directory' AS kind, NULL AS size FROM place UNION ALL SELECT ord, source, 'record', size FROM record")
def source_union(spark, sf_dir):
    a = places(spark, sf_dir).select(F.col("place").alias("id"), "source", F.lit("directory").alias("kind"))
    b = records(spark, sf_dir).select(F.col("ord").alias("id"), "source", F.lit("record").alias("kind"), "size")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [a, b])


@query(WITH + "SELECT place, concat_ws(',', CASE WHEN is_walk_in THEN 'walk_in' END, CASE WHEN is_appointment THEN 'appointment_required' END, CASE WHEN is_no_id THEN 'no_id_required' END, CASE WHEN is_photo_id THEN 'photo_id' END, CASE WHEN is_proof THEN 'proof_of_address' END, CASE WHEN is_income THEN 'income_verification' END, main_service) AS tags FROM place")
def array_union_ordered(spark, sf_dir):
    return places(spark, sf_dir).select("place", F.array_join(F.array_union("requirements", "services"), ",").alias("tags"))


@query(WITH + "SELECT zip FROM record EXCEPT SELECT p_brand FROM part WHERE p_size > 48")
def key_set_difference(spark, sf_dir):
    return records(spark, sf_dir).select("zip").subtract(table(spark, sf_dir, "part").where("p_size > 48").select(F.col("p_brand").alias("zip"))).distinct()


@query(WITH + "SELECT place, website FROM place WHERE length(trim(place_name)) > 0")
def valid_rows(spark, sf_dir):
    return files.valid_records(places(spark, sf_dir).withColumnRenamed("place_name", "name")).select("place", "website")


@query(WITH + "SELECT place FROM place WHERE main_service IN ('delivery', 'produce')")
def service_overlap(spark, sf_dir):
    return places(spark, sf_dir).where(F.arrays_overlap("services", F.array(F.lit("delivery"), F.lit("produce")))).select("place")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(?i:page )?\\d+$'))) AS n_blocks FROM documents")
def text_block_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pages.text_blocks(F.col("text"))).cast("long").alias("n_blocks"))


#: Documents whose every third line begins a block.
_PAGED = r"regexp_replace(text, '\n([^\n]*)\n([^\n]*)\n', chr(10) || '\1' || chr(10) || '\2' || chr(10) || ' ' || chr(10), 'g')"


@query(rf"""WITH blocks AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_PAGED}, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:page )?\d+$')) AS bs FROM documents)
, told AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS block, list_filter(list_transform(string_split(bs[k], chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS k FROM blocks))
, said AS (SELECT doc_id, block, ls[1] AS name, array_to_string(ls, ' ') AS t FROM told)
, found AS (SELECT doc_id, block, name, md5(t) AS text_md5, nullif(regexp_extract(t, '{pages.PHONE}'), '') AS phone, nullif(regexp_extract(t, '{pages.ADDRESS}'), '') AS address, nullif(regexp_extract(t, '(?:^|[^0-9])([0-9]{{5}})(?:[^0-9]|$)', 1), '') AS zip FROM said WHERE length(name) BETWEEN 3 AND 150)
SELECT * FROM found WHERE coalesce(phone, address, zip) IS NOT NULL""")
def text_block_records(spark, sf_dir):
    paged = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\n([^\n]*)\n([^\n]*)\n", "\n$1\n$2\n \n").alias("text"))
    found = pages.block_records(paged, "doc_id", "text")
    return found.select("doc_id", "block", "name", F.md5("text").alias("text_md5"), "phone", "address", "zip")
