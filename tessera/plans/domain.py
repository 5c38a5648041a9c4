"""The directory's entities, made from the driver's tables by arithmetic on keys that Spark and SQL agree on.

Each entity is a list of (name, expression); the expressions are valid in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hours
from tessera.session import table

#: The person who asks, and when: Monday (0), minute 630 of the day.
AT_LAT, AT_LON, WEEKDAY, MINUTE = 38.9284, -77.0323, 0, 630

PLACE = [
    ("place", "c_custkey"),
    ("place_name", "c_name"),
    ("zip", "CAST(20001 + (c_nationkey * 197) % 4600 AS STRING)"),
    ("area", "c_nationkey"),
    ("place_lat", "38.5e0 + ((c_custkey * 37) % 1000) / 1000e0"),
    ("place_lon", "-77.5e0 + ((c_custkey * 91) % 1000) / 1000e0"),
    ("source", "CASE c_custkey % 5 WHEN 0 THEN 'mocofood' WHEN 1 THEN 'cafb' WHEN 2 THEN 'two11md' WHEN 3 THEN 'two11va' ELSE 'mdfb-find-food' END"),
    ("hours", "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Mon: 9am-5pm' WHEN 2 THEN 'Mon: 9:30 am - 12 pm, Wed: 1pm-4:30pm' WHEN 3 THEN 'Saturday 10:00-14:00' WHEN 4 THEN '' ELSE 'Tuesday 10 am - 2 pm; Thursday 10 am - 2 pm bring a bag' END"),
    ("is_walk_in", "c_custkey % 3 = 0"),
    ("is_appointment", "c_custkey % 4 = 1"),
    ("is_no_id", "c_custkey % 5 < 2"),
    ("is_photo_id", "c_custkey % 7 = 3"),
    ("is_proof", "c_custkey % 11 = 5"),
    ("is_income", "c_custkey % 13 = 4"),
    ("speaks_es", "c_custkey % 3 = 1"),
    ("speaks_am", "c_custkey % 6 = 2"),
    ("speaks_fr", "c_custkey % 10 = 7"),
    ("main_service", "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'food_pantry' WHEN 'MACHINERY' THEN 'hot_meals' WHEN 'BUILDING' THEN 'delivery' WHEN 'AUTOMOBILE' THEN 'mobile_pantry' ELSE 'produce' END"),
    ("tone", "((c_custkey * 13) % 100) / 100e0"),
    ("n_sources", "1 + c_custkey % 4"),
    ("phone", "CASE WHEN c_custkey % 2 = 0 THEN '1-301-555-' || CAST(1000 + c_custkey % 9000 AS STRING) END"),
    ("website", "CASE WHEN c_custkey % 3 < 2 THEN 'http://www.place' || CAST(c_custkey % 700 AS STRING) || '.Example.org/' END"),
    ("hero_copy", "CASE WHEN c_custkey % 4 < 3 THEN 'Open to all — come by' END"),
    ("accepts_food", "c_custkey % 4 = 0"),
    ("accepts_money", "c_custkey % 6 = 1"),
    ("accepts_volunteers", "c_custkey % 5 = 2"),
    ("stop_name", "CASE WHEN c_custkey % 2 = 1 THEN 'Stop ' || CAST(c_custkey % 94 AS STRING) || ' (red)' END"),
    ("balance", "c_acctbal"),
]
AREA = [
    ("area", "n_nationkey"),
    ("label", "n_name"),
    ("parent", "n_regionkey"),
    ("lat", "38.5e0 + ((n_nationkey * 41) % 100) / 100e0"),
    ("lon", "-77.5e0 + ((n_nationkey * 17) % 100) / 100e0"),
    ("poverty", "(3 + (n_nationkey * 7) % 30) / 100e0"),
    ("snap", "(2 + (n_nationkey * 11) % 25) / 100e0"),
    ("population", "5000 + (n_nationkey * 3571) % 40000"),
]
STATION = [
    ("station", "s_suppkey"),
    ("station_name", "s_name"),
    ("line", "CASE s_nationkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'green' END"),
    ("s_lat", "38.5e0 + ((s_suppkey * 53) % 1000) / 1000e0"),
    ("s_lon", "-77.5e0 + ((s_suppkey * 29) % 1000) / 1000e0"),
    ("is_metro", "s_suppkey % 2 = 0"),
]
RECORD = [
    ("ord", "p_partkey"),
    ("name", "CASE p_partkey % 3 WHEN 0 THEN p_name || ', Inc.' WHEN 1 THEN upper(p_name) ELSE p_name END"),
    ("plain_name", "p_name"),
    ("zip", "p_brand"),
    ("address", "CAST(p_partkey % 5 AS STRING) || ' Main St, Rockville, MD 20850'"),
    ("source", "CASE p_partkey % 5 WHEN 0 THEN 'mocofood' WHEN 1 THEN 'cafb' WHEN 2 THEN 'two11md' WHEN 3 THEN 'two11va' ELSE 'mdfb-find-food' END"),
    ("hours", "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE 'Mon ' || CAST(p_size % 3 AS STRING) END"),
    ("phone", "CASE WHEN p_partkey % 6 < 3 THEN '301555' || CAST(1000 + p_partkey % 9000 AS STRING) END"),
    ("website", "CASE WHEN p_partkey % 5 = 2 THEN 'https://w' || CAST(p_partkey AS STRING) || '.org' END"),
    ("hero_copy", "CASE WHEN p_partkey % 7 < 2 THEN 'Hello' END"),
    ("is_walk_in", "p_partkey % 3 = 0"),
    ("is_appointment", "p_partkey % 3 = 1"),
    ("speaks_es", "p_partkey % 4 = 2"),
    ("accepts_food", "p_partkey % 9 = 0"),
    ("size", "p_size"),
]


def sql(entity: list[tuple[str, str]], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in entity)} FROM {source}"


WITH = f"WITH place AS ({sql(PLACE, 'customer')}), area AS ({sql(AREA, 'nation')}), station AS ({sql(STATION, 'supplier')}), record AS ({sql(RECORD, 'part')}) "

#: The same rules in SQL, for the statements that results are held against.
HAVERSINE = "(2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2)))))"
STATE = "CASE place % 6 WHEN 0 THEN 'unknown' WHEN 4 THEN 'unknown' WHEN 1 THEN 'open' WHEN 2 THEN 'open' ELSE 'opens_this_week' END"


def flags_to_tags(flags: dict[str, str]):
    """The names of the flags that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(name)) for c, name in flags.items()]))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in PLACE])
    return rows.withColumns(
        {
            "requirements": flags_to_tags({"is_walk_in": "walk_in", "is_appointment": "appointment_required", "is_no_id": "no_id_required", "is_photo_id": "photo_id", "is_proof": "proof_of_address", "is_income": "income_verification"}),
            "languages": F.array_compact(F.array(F.lit("en"), F.when(F.col("speaks_es"), "es"), F.when(F.col("speaks_am"), "am"), F.when(F.col("speaks_fr"), "fr"))),
            "services": F.array("main_service"),
            "has_hours": F.coalesce(F.length("hours") > 0, F.lit(False)),
        }
    )


def by_hours(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with columns that follow from ``hours`` and its ``entries`` alone, worked out once for each text that occurs.

    The text that is parsed is an aggregate's, not the key itself: filters on what follows from a key are moved to every row.
    """
    texts = rows.groupBy(F.col("hours").alias("__hours")).agg(F.min("hours").alias("hours"))
    told = texts.withColumn("entries", hours.parse_hours(F.col("hours"))).select("__hours", *columns)
    return rows.join(told, F.col("hours").eqNullSafe(F.col("__hours"))).drop("__hours")


def with_status(rows: DataFrame) -> DataFrame:
    status = hours.open_status(F.col("entries"), F.col("hours"), F.lit(WEEKDAY), F.lit(MINUTE))
    rows = by_hours(rows, status.alias("__status"))
    return rows.withColumns({"state": F.col("__status.state"), "state_label": F.col("__status.label")}).drop("__status")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*[f"{e} AS {n}" for n, e in AREA])


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {n}" for n, e in STATION])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in RECORD])
    return rows.withColumns(
        {
            "requirements": flags_to_tags({"is_walk_in": "walk_in", "is_appointment": "appointment_required"}),
            "languages": F.array_compact(F.array(F.when(F.col("speaks_es"), "Spanish"))),
            "filled": sum((F.coalesce(F.length(c) > 0, F.lit(False)).cast("int") for c in ("address", "hours", "phone", "website", "hero_copy")), F.lit(0)),
        }
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
