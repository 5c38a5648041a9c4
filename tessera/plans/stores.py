"""Queries on what comes from outside and what is kept: fetched pages, a cache with versions, ingested events."""

from __future__ import annotations

import ssl
import uuid

from pyspark.sql import functions as F

from tessera.functions import geo, text
from tessera.operators import asof, lookup
from tessera.plans.catalogue import query
from tessera.plans.domain import WITH, places, records
from tessera.session import shared_folder, table
from tessera.sources import external
from tessera.sources.fetching import FetchedPages
from tessera.sources.versions import Versions
from tessera.streaming import ingest


def first_client(request: dict, seconds: float) -> str:
    """Pages as they were recorded; of ten addresses three fail in ways of their own, a fourth is only had from the second."""
    return _recorded(request, {3: ssl.SSLError("certificate verify failed"), 5: ConnectionError("reset"), 7: TimeoutError("timed out"), 9: ValueError("403")})


def second_client(request: dict, seconds: float) -> str:
    return _recorded(request, {3: ssl.SSLError("certificate verify failed"), 7: TimeoutError("timed out"), 9: KeyError("403")})


def _recorded(request: dict, failures: dict[int, Exception]) -> str:
    if failure := failures.get(request["page_id"] % 10):
        raise failure
    return request["html"]


_FETCHED = """WITH fetched AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, page_id % 10 AS k, html FROM pages)
, told AS (SELECT *, CASE k WHEN 3 THEN 'ssl_error' WHEN 7 THEN 'timeout' WHEN 9 THEN 'error:KeyError' ELSE 'ok' END AS status FROM fetched)"""


def _fetched(spark, sf_dir):
    spark.dataSource.register(FetchedPages)
    named = ",".join(f"{__name__}:{c}" for c in ("first_client", "second_client"))
    return spark.read.format("fetched_pages").options(requests=f"{sf_dir}/pages.parquet", clients=named, columns="page_id,html", partitions=6, seconds=20).load()


@query(_FETCHED + " SELECT url, host, status, CASE WHEN status = 'ok' THEN CASE k WHEN 5 THEN 'second_client' ELSE 'first_client' END END AS client, CASE WHEN status = 'ok' THEN length(html) END AS size, CASE WHEN status = 'ok' THEN md5(html) END AS content_md5 FROM told")
def fetched_pages(spark, sf_dir):
    return _fetched(spark, sf_dir).select("url", "host", "status", "client", "size", F.md5("content").alias("content_md5"))


@query(_FETCHED + " SELECT host, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'timeout') AS n_timeout, count(*) FILTER (WHERE status NOT IN ('ok', 'timeout')) AS n_error FROM told GROUP BY host")
def fetch_statuses(spark, sf_dir):
    counted = [F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "timeout").alias("n_timeout"), F.count_if(~F.col("status").isin("ok", "timeout")).alias("n_error")]
    return _fetched(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"), *counted)


def _cache(spark):
    return Versions(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}", "key string, result string, written int")


_ANSWERS = WITH + """, keyed AS (SELECT ord, ord % 3 AS part, md5('2' || chr(31) || source || chr(31) || plain_name) AS key FROM record)
, first_run AS (SELECT DISTINCT key FROM keyed WHERE part = 0)"""


def _keyed(spark, sf_dir):
    return records(spark, sf_dir).select("ord", (F.col("ord") % 3).alias("part"), text.cache_key(F.lit("2"), F.col("source"), F.col("plain_name")).alias("key"))


def _answer(turn: int):
    return lambda keys: keys.select("key", F.concat(F.lit(f"{turn}:"), F.substring("key", 1, 6)).alias("result"), F.lit(turn).alias("written"))


@query(_ANSWERS + " SELECT ord, CASE WHEN f.key IS NULL THEN 'miss' ELSE 'hit' END AS cache_state, CASE WHEN f.key IS NULL THEN '2:' ELSE '1:' END || substr(k.key, 1, 6) AS result FROM keyed k LEFT JOIN first_run f ON k.key = f.key")
def answers_by_content(spark, sf_dir):
    """Results kept by what they were made of: a first run fills the cache for a third of the records, a second asks for the rest."""
    cache, rows = _cache(spark), _keyed(spark, sf_dir)
    lookup.answered(rows.where("part = 0"), cache, "key", _answer(1))
    return lookup.answered(rows, cache, "key", _answer(2)).select("ord", "cache_state", "result")


@query(_ANSWERS + """, puts AS (SELECT key, 1 AS written, ord FROM keyed WHERE part < 2 UNION ALL SELECT key, 2, ord FROM keyed WHERE part > 0 UNION ALL SELECT key, 3, ord FROM keyed WHERE ord % 7 = 0)
, last AS (SELECT key, max(written) AS written FROM puts GROUP BY key) SELECT key, written, CAST(max(ord) AS STRING) AS result FROM puts JOIN last USING (key, written) GROUP BY key, written""")
def cache_after_upserts(spark, sf_dir):
    """What a cache holds after three upserts: the last write of each key, and within one the row of the greatest number."""
    cache, rows = _cache(spark), _keyed(spark, sf_dir)
    for turn, chosen in ((1, "part < 2"), (2, "part > 0"), (3, "ord % 7 = 0")):
        cache.upsert(rows.where(chosen).select("key", F.col("ord").cast("string").alias("result"), F.lit(turn).alias("written"), "ord"), "ord")
    return cache.read()


_LINE = "CASE WHEN event_id % 50 = 7 THEN '{\"event\": \"' || event_type WHEN event_id % 50 = 8 THEN 'no json' ELSE '{\"event\": \"' || event_type || '\", \"zip\": \"' || CAST(20000 + user_id % 100 AS STRING) || '\"}' END"


def _ingested(spark, sf_dir):
    at = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "events").select(F.expr(_LINE).alias("value"), (F.col("event_id") % 3).alias("part"))
    for part in range(2):  # what comes in at two times
        lines.where((F.col("part") == 0) == (part == 0)).select("value").write.mode("append").text(f"{at}/in")
        ingest.ingest(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return f"{at}/out"


_LINES = f"WITH lines AS (SELECT {_LINE} AS value, event_type, 20000 + user_id % 100 AS zip, event_id % 50 IN (7, 8) AS broken FROM events)"


@query(_LINES + " SELECT event_type AS event, CAST(zip AS STRING) AS zip, count(*) AS n FROM lines WHERE NOT broken GROUP BY ALL")
def ingested_events(spark, sf_dir):
    return ingest.events(spark, _ingested(spark, sf_dir)).groupBy("event", "zip").agg(F.count("*").alias("n"))


@query(_LINES + " SELECT value, count(*) AS n FROM lines WHERE broken GROUP BY value")
def rejected_lines(spark, sf_dir):
    return ingest.rejects(spark, _ingested(spark, sf_dir)).groupBy("value").agg(F.count("*").alias("n"))


@query(_LINES + " SELECT 2 AS n_batches, count(*) AS n_lines, count(*) FILTER (WHERE NOT broken) AS n_events, count(*) FILTER (WHERE broken) AS n_rejected FROM lines")
def ingest_audit(spark, sf_dir):
    audit = ingest.audit(spark, _ingested(spark, sf_dir))
    return audit.agg(F.count("*").alias("n_batches"), *[F.sum(c).alias(c) for c in ("n_lines", "n_events", "n_rejected")])


_DATED = "CAST(l_shipdate AS TIMESTAMP) AS since, CASE WHEN l_linenumber = 1 THEN 10e0 ELSE 38.5e0 + (l_partkey % 1000) / 1000e0 END AS lat, -77.0e0 AS lon"
_STOPS = f"""WITH asked AS (SELECT o_orderkey, o_custkey % 40 AS stop, CAST(o_orderdate AS TIMESTAMP) AS moment FROM orders)
, cached AS (SELECT stop, since, max(lat) AS lat FROM (SELECT l_suppkey % 40 AS stop, {_DATED} FROM lineitem WHERE l_orderkey % 97 < 8 AND l_suppkey % 3 = 0) WHERE lat > 37.5 GROUP BY stop, since)
, served AS (SELECT stop, since, max(lat) AS lat FROM (SELECT l_suppkey % 40 AS stop, {_DATED} FROM lineitem WHERE l_orderkey % 89 < 8 AND l_suppkey % 40 % 2 = 0) WHERE lat > 37.5 GROUP BY stop, since)
, listed AS (SELECT s_suppkey % 50 AS stop, min(38.5e0 + ((s_suppkey * 53) % 1000) / 1000e0) AS lat FROM supplier WHERE s_suppkey % 50 < 35 GROUP BY 1)
, first AS (SELECT a.*, c.since AS c_since, c.lat AS c_lat FROM asked a ASOF LEFT JOIN cached c ON a.stop = c.stop AND a.moment >= c.since)
, second AS (SELECT f.*, s.since AS s_since, s.lat AS s_lat FROM first f ASOF LEFT JOIN served s ON f.stop = s.stop AND f.moment >= s.since)
, told AS (SELECT t.*, l.lat AS l_lat, CASE WHEN date_diff('second', c_since, moment) < 90 * 86400 THEN 'cache' WHEN s_since IS NOT NULL THEN 'service' WHEN l.lat IS NOT NULL THEN 'static' ELSE 'none' END AS answered_by FROM second t LEFT JOIN listed l ON t.stop = l.stop)
"""


@query(_STOPS + "SELECT o_orderkey, answered_by, CASE answered_by WHEN 'cache' THEN c_lat WHEN 'service' THEN s_lat WHEN 'static' THEN l_lat END AS lat FROM told")
def stops_asked_for(spark, sf_dir):
    """Where a stop was, for each request at its time: by the cache if it was fresh, by the service, or by the fixed list."""
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 40 AS stop", "CAST(o_orderdate AS TIMESTAMP) AS at")
    dated = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_suppkey", "l_suppkey % 40 AS stop", *_DATED.split(", ", 1)[:1], "CASE WHEN l_linenumber = 1 THEN 10e0 ELSE 38.5e0 + (l_partkey % 1000) / 1000e0 END AS lat", "-77.0e0 AS lon")
    static = table(spark, sf_dir, "supplier").where("s_suppkey % 50 < 35").selectExpr("s_suppkey % 50 AS stop", "38.5e0 + ((s_suppkey * 53) % 1000) / 1000e0 AS lat", "-77.0e0 AS lon")
    found = asof.stops_as_of(asked, dated.where("l_orderkey % 97 < 8 AND l_suppkey % 3 = 0"), dated.where("l_orderkey % 89 < 8 AND stop % 2 = 0"), static, "at", 90)
    return found.select("o_orderkey", "answered_by", "lat")


@query(WITH + ", keyed AS (SELECT place, printf('%.4f', floor(place_lat * 10000 + 0.5e0) / 10000) || '_' || printf('%.4f', floor(place_lon * 10000 + 0.5e0) / 10000) AS cell, balance FROM place) SELECT place, cell, first_value(balance) OVER (PARTITION BY cell ORDER BY place) AS shared FROM keyed")
def stops_shared_by_place(spark, sf_dir):
    """What was found for the first record at a place, to four decimals, goes for all records there."""
    rows = places(spark, sf_dir).select("place", "place_lat", "place_lon", F.col("balance").alias("shared"))
    key = geo.cell_key(F.col("place_lat"), F.col("place_lon"), 4)
    return lookup.shared_by_first(rows, key, "place", ["shared"]).select("place", geo.cell_key(F.col("place_lat"), F.col("place_lon"), 4).alias("cell"), "shared")


def directions_service(row: dict) -> dict:
    """A service that of seven requests answers four, is too busy for one, refuses one and never ends one."""
    match row["place"] % 7:
        case 3:
            raise external.failure_of(429)
        case 5:
            raise external.failure_of(404)
        case 6:
            raise TimeoutError
    return {"directions": f"Route {row['place']}", "recommended": "asked"}


_MODES = WITH + """, asked AS (SELECT place, CASE WHEN place % 3 > 0 THEN 'Fort Totten' END AS metro, 'RD/GR' AS metro_lines, 1 + place % 20 AS metro_minutes, CASE WHEN place % 4 > 1 THEN '70' END AS bus, 2 + place % 15 AS bus_minutes FROM place)"""


@query(_MODES + """, own AS (SELECT *, 'Take the ' || metro_lines || ' line to ' || metro || ', then walk ' || metro_minutes || ' minutes.' AS m, 'Take bus ' || bus || ', then walk ' || bus_minutes || ' minutes.' AS b FROM asked)
SELECT place, CASE WHEN place % 7 IN (3, 5, 6) THEN nullif(concat_ws(' ', m, b), '') ELSE 'Route ' || place END AS directions,
 CASE WHEN place % 7 NOT IN (3, 5, 6) THEN 'asked' WHEN m IS NOT NULL AND (b IS NULL OR metro_minutes <= bus_minutes) THEN 'metro' WHEN b IS NOT NULL THEN 'bus' END AS recommended,
 CASE place % 7 WHEN 3 THEN 'own:retries' WHEN 5 THEN 'own:ValueError' WHEN 6 THEN 'own:timeout' ELSE 'ok' END AS status, CASE WHEN place % 2 = 0 THEN 'hit' ELSE 'miss' END AS cache_state FROM own""")
def transit_directions(spark, sf_dir):
    """Directions through the hook, by our own rules where the service fails; the second run asks for what the first didn't."""
    fields = ["CASE WHEN place % 3 > 0 THEN 'Fort Totten' END AS metro", "'RD/GR' AS metro_lines", "1 + place % 20 AS metro_minutes", "CASE WHEN place % 4 > 1 THEN '70' END AS bus", "2 + place % 15 AS bus_minutes"]
    rows = places(spark, sf_dir).selectExpr("place", "CAST(place AS STRING) AS key", *fields)
    cache = Versions(spark, f"{shared_folder(spark)}/directions-{uuid.uuid4().hex}", "key string, directions string, recommended string, status string")
    patience = external.Patience(2, {external.Throttled: 0.0, external.Retry: 0.0})

    def fetch(keys):
        return external.enrich(rows.join(keys, "key"), directions_service, "directions string, recommended string", patience, external.directions).select("key", "directions", "recommended", "status")

    lookup.answered(rows.where("place % 2 = 0"), cache, "key", fetch)
    return lookup.answered(rows, cache, "key", fetch).select("place", "directions", "recommended", "status", "cache_state")
