"""Queries on files, texts of places, labels of times, and sentences."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import hours, text
from tessera.operators import equity, lookup, metrics, ranking
from tessera.plans.catalogue import query
from tessera.plans.domain import WITH, areas, events, places, records
from tessera.plans.places import _ACCESS, _NEAR, _access, _gaps
from tessera.plans.resolution import _GROUPS, _merged
from tessera.session import shared_folder, table
from tessera.sources import files, pages


def _path(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(WITH + "SELECT ord, name, zip FROM record")
def record_files(spark, sf_dir):
    """Records written as lines, with their statistics beside them, and read again."""
    path = _path(spark)
    files.write_records(records(spark, sf_dir).select("ord", "name", "zip"), path, stage="resolution")
    return files.read_records(spark, path, "ord long, name string, zip string")


@query("SELECT count(*) AS total, 'resolution' AS stage FROM part")
def record_file_stats(spark, sf_dir):
    path = _path(spark)
    files.write_records(records(spark, sf_dir).select("ord"), path, stage="resolution")
    return files.read_stats(spark, path).select("total", F.col("stats")["stage"].alias("stage"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def envelope_records(spark, sf_dir):
    """The records of one document with statistics, as others write it: 25 rows."""
    path = _path(spark)
    listed = table(spark, sf_dir, "nation").agg(F.count("*").alias("total"), F.collect_list(F.struct("n_nationkey", "n_name")).alias("records"))
    listed.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return files.read_envelope(spark, path, "n_nationkey:bigint,n_name:string")


@query("SELECT event_type AS event, CAST(20000 + user_id % 100 AS VARCHAR) AS zip, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY ALL")
def broken_lines(spark, sf_dir):
    """A log in which every tenth line is cut off."""
    path = _path(spark)
    line = F.to_json(F.struct(F.col("event_type").alias("event"), (20000 + F.col("user_id") % 100).cast("string").alias("zip")))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return files.read_events(spark, path).groupBy("event", "zip").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def richest_input(spark, sf_dir):
    """The latest stage's table where there is one, else the one before."""
    return files.richest(spark, [f"{sf_dir}/{name}.parquet" for name in ("weather", "transit", "nation")]).select("n_nationkey", "n_name")


@query("SELECT p_partkey FROM part")
def absent_cache(spark, sf_dir):
    """All rows are to be done where no cache has been written yet."""
    cache = files.read_cache(spark, f"{sf_dir}/no_such_cache.parquet", "p_partkey bigint, found string")
    return lookup.todo(table(spark, sf_dir, "part").select("p_partkey"), cache, "p_partkey")


@query("SELECT 'nation' AS source_id, 'ok' AS status, count(*) AS n FROM nation UNION ALL SELECT 'region', 'ok', count(*) FROM region UNION ALL SELECT 'broken', 'error: offline', NULL")
def source_statuses(spark, sf_dir):
    """Three sources, of which one fails, and what became of each."""
    def broken():
        raise OSError("offline")

    sources = {"nation": lambda: table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "region": lambda: table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "broken": broken}
    rows, status = files.collect_sources(sources, ["nation", "broken", "region"])
    told = spark.createDataFrame(list(status.items()), "source_id string, status string")
    return told.join(rows.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left")


@query(WITH + "SELECT ord, CASE ord % 3 WHEN 0 THEN '1 Elm St' WHEN 1 THEN '2 Elm St' ELSE ord || '.5 mi of road' END AS address FROM record")
def address_endings(spark, sf_dir):
    """Addresses without the distance or the country that sources add at their end."""
    given = F.expr("CASE ord % 3 WHEN 0 THEN concat('1 Elm St  ', ord, '.2 mi') WHEN 1 THEN '2 Elm St USA ' ELSE concat(ord, '.5 mi of road') END")
    return records(spark, sf_dir).select("ord", text.without_distance(given).alias("address"))


@query("SELECT p_partkey, concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'Mon: ' || p_size || 'am; noon' END, CASE WHEN p_size % 3 = 0 THEN 'Wed: 1pm' END, CASE WHEN p_size % 5 = 0 THEN 'Sun: closed' END) AS hours FROM part")
def day_hours(spark, sf_dir):
    """One column for each day as one text, without blank days."""
    days = {"Mon": "CASE WHEN p_size % 2 = 0 THEN concat(p_size, 'am\r\nnoon') END", "Tue": "' '", "Wed": "CASE WHEN p_size % 3 = 0 THEN '1pm' ELSE '' END", "Sun": "CASE WHEN p_size % 5 = 0 THEN 'closed' END"}
    return table(spark, sf_dir, "part").select("p_partkey", pages.wide_hours({d: F.expr(e) for d, e in days.items()}).alias("hours"))


@query(WITH + "SELECT ord, concat_ws(' | ', name, CASE WHEN length(trim(hours)) > 0 THEN hours END, phone, hero_copy) AS raw_text FROM record")
def raw_texts(spark, sf_dir):
    return records(spark, sf_dir).select("ord", text.joined(" | ", *[F.col(c) for c in ("name", "hours", "phone", "hero_copy")]).alias("raw_text"))


@query("SELECT doc_id, length(combined) AS n, md5(combined) AS digest FROM (SELECT doc_id, substr(concat_ws(chr(10) || '--- page ---' || chr(10), source || ' ' || doc_id, substr(text, 1, 3000)), 1, 4000) AS combined FROM documents)")
def extraction_texts(spark, sf_dir):
    """What an extraction service is given of a record and its page: its limits, not ours."""
    combined = text.combined_text(F.concat_ws(" ", "source", F.col("doc_id").cast("string")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(combined).cast("long").alias("n"), F.md5(combined).alias("digest"))


@query(_NEAR + """SELECT area, label || ': ' || format('{:,}', underserved) || ' underserved residents, ' || n_places || CASE WHEN n_places = 1 THEN ' resource' ELSE ' resources' END || '; a gift counts ' || round(gap / 0.03e0, 1) || ' times.' AS message FROM gaps WHERE gap > 0.01""")
def urgency_messages(spark, sf_dir):
    found = _gaps(spark, sf_dir).withColumn("u", equity.urgency(F.col("gap"))).where("u.level IS NOT NULL")
    return found.select("area", equity.urgency_message(F.col("label"), F.col("underserved"), F.col("n_places"), F.col("u.multiplier")).alias("message"))


_CLOSED = "concat_ws(', ', " + ", ".join(f"CASE WHEN open_{d} = 0 THEN '{n}' END" for d, n in zip(hours.DAYS, ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"], strict=True)) + ")"


@query(_ACCESS + f""", named AS (SELECT scored.*, label FROM scored JOIN area USING (area))
SELECT area, CASE WHEN n_places = 0 THEN 'Nothing here can be reached on foot.' ELSE concat_ws(' ', CASE WHEN {_CLOSED} <> '' THEN 'Every place is closed on ' || {_CLOSED} || '.' END, CASE WHEN low_friction = 0 THEN 'Each place asks for an appointment or a document.' END,
 CASE WHEN area % 2 = 0 AND speaks_spanish = 0 THEN 'Nobody speaks Spanish at the places of ' || label || '.' END, CASE WHEN area % 2 = 0 AND speaks_amharic = 0 THEN 'Nobody speaks Amharic at the places of ' || label || '.' END) END AS lacks FROM named""")
def access_gap_texts(spark, sf_dir):
    """What each area lacks; every second one has many speakers of Spanish and Amharic."""
    return _access(spark, sf_dir).select("area", F.array_join(equity.access_gaps(F.col("label"), F.col("area") % 2 == 0), " ").alias("lacks"))


@query("""SELECT event_id, CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Tomorrow' WHEN epoch_us(start) - epoch_us(TIMESTAMP '2024-01-10 12:00:00') < 7 * 86400000000 THEN dayname(start) ELSE monthname(start) || ' ' || day(start) END AS label,
 (epoch_us(start) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) // 60000000 AS minutes, strftime(start, '%-I:%M %p') || '–' || strftime(start + INTERVAL 90 MINUTE, '%-I:%M %p') AS hours, round((hour(start) * 60 + minute(start)) / 1440e0, 6) AS fraction
FROM (SELECT event_id, ts AS start, date_diff('day', DATE '2024-01-10', CAST(ts AS DATE)) AS d FROM events) WHERE start >= TIMESTAMP '2024-01-10 12:00:00'""")
def time_labels(spark, sf_dir):
    """When events are, as people say it on the tenth of January 2024 at noon."""
    now, start = F.lit("2024-01-10 12:00:00").cast("timestamp"), F.col("ts")
    minute = F.hour(start) * 60 + F.minute(start)
    window = hours.window_label(start, start + F.expr("INTERVAL 90 MINUTE"), now)
    label = hours.day_label(start, now)
    return events(spark, sf_dir).where(start >= now).select(
        "event_id", label.alias("label"), hours.minutes_until(start, now).alias("minutes"), F.substr(window, F.length(label) + 2).alias("hours"), F.round(hours.day_progress(minute), 6).alias("fraction")
    )


@query(WITH + "SELECT 'ranked' AS found, place, place_name FROM place WHERE place = 8 UNION ALL SELECT 'all', place, place_name FROM place WHERE place = 11")
def place_by_id(spark, sf_dir):
    """A place among the ranked ones, and one that isn't and is looked up among all."""
    every = places(spark, sf_dir).select("place", "place_name")
    ranked = every.where("place % 4 = 0").withColumn("found", F.lit("ranked"))
    asked = [ranking.point_lookup(ranked, every, "place", key) for key in (8, 11, -1)]
    return asked[0].unionByName(asked[1]).unionByName(asked[2]).select(F.coalesce("found", F.lit("all")).alias("found"), "place", "place_name")


@query(_GROUPS + "SELECT grp, CASE WHEN bool_or(speaks_es) THEN 'Spanish' ELSE '' END AS languages FROM ranked GROUP BY grp")
def merged_languages(spark, sf_dir):
    return _merged(spark, sf_dir).select(F.col("group").alias("grp"), F.array_join("languages", ",").alias("languages"))


@query(_GROUPS + ", sizes AS (SELECT grp, count(DISTINCT source) AS n FROM ranked GROUP BY grp) SELECT count(*) AS records, count(CASE WHEN n > 1 THEN 1 END) AS several_sources, round(100e0 * count(CASE WHEN n > 1 THEN 1 END) / count(*), 1) AS percent FROM sizes")
def several_sources(spark, sf_dir):
    return metrics.several_sources(_merged(spark, sf_dir))


_SHOWN = {"open": {"en": "Open", "es": "Abierto"}, "closed": {"en": "Closed"}}


@query(WITH + "SELECT place, lang, CASE place % 3 WHEN 0 THEN CASE lang WHEN 'es' THEN 'Abierto' ELSE 'Open' END WHEN 1 THEN 'Closed' ELSE 'call_first' END AS shown FROM (SELECT place, CASE place % 2 WHEN 0 THEN 'es' ELSE 'am' END AS lang FROM place)")
def interface_texts(spark, sf_dir):
    """Labels in the reader's language, else in English, else by their key."""
    rows = places(spark, sf_dir).select("place", F.expr("CASE place % 2 WHEN 0 THEN 'es' ELSE 'am' END").alias("lang"), F.expr("CASE place % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'call_first' END").alias("label"))
    return rows.select("place", "lang", text.interface_text(F.col("label"), F.col("lang"), _SHOWN).alias("shown"))


_FIELDS = ["hours", "phone", "website", "hero_copy", "stop_name"]


@query(WITH + ", s AS (SELECT *, CASE WHEN place % 9 = 0 THEN NULL WHEN place % 2 = 0 THEN 'MD' ELSE 'VA' END AS state FROM place) SELECT 'state' AS kind, coalesce(state, 'unknown') AS name, count(*) AS n, NULL AS percent FROM s GROUP BY ALL UNION ALL SELECT 'source', source, count(*), NULL FROM s GROUP BY ALL UNION ALL SELECT 'total', 'records', count(*), NULL FROM s"
       + "".join(f" UNION ALL SELECT 'field', '{f}', count(CASE WHEN length({f}) > 0 THEN 1 END), round(100e0 * count(CASE WHEN length({f}) > 0 THEN 1 END) / count(*), 1) FROM s" for f in _FIELDS))
def export_metadata(spark, sf_dir):
    """What an export says of itself: records by state and source, and how many have each field."""
    rows = places(spark, sf_dir).withColumn("state", F.expr("CASE WHEN place % 9 = 0 THEN NULL WHEN place % 2 = 0 THEN 'MD' ELSE 'VA' END"))
    return metrics.metadata(rows, ["state", "source"], _FIELDS)


@query(WITH + ", told AS (SELECT area, CAST(floor(lat * 10 + 0.5e0) AS BIGINT) AS y, CAST(floor(lon * 10 + 0.5e0) AS BIGINT) AS x FROM area), one AS (SELECT y, x, min(area) AS reading FROM told GROUP BY y, x) SELECT place, reading FROM place LEFT JOIN one ON y = CAST(floor(place_lat * 10 + 0.5e0) AS BIGINT) AND x = CAST(floor(place_lon * 10 + 0.5e0) AS BIGINT)")
def readings_by_cell(spark, sf_dir):
    """Each place with what was fetched for its rounded coordinates."""
    fetched = areas(spark, sf_dir).select("lat", "lon", F.col("area").alias("reading"))
    return lookup.by_cell(places(spark, sf_dir).select("place", "place_lat", "place_lon"), fetched, ("place_lat", "place_lon"), ("lat", "lon"), "reading", 1).select("place", "reading")
