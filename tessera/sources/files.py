"""Sources and sinks: JSON envelopes, event logs, registries of sources, and cache tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shared_folder

EVENT = "event string, ts timestamp, receivedAt timestamp, zip string, filters array<string>, orgId string, orgName string, fromPage string, filter string, value boolean, page string"


def read_envelope(spark: SparkSession, path: str, record: str | T.StructType) -> DataFrame:
    """The ``records`` of ``{stats, total, records: [...]}`` files, with a given schema so that nothing is inferred."""
    kind = record if isinstance(record, str) else record.simpleString()[7:-1]
    return spark.read.option("multiLine", True).schema(f"records array<struct<{kind.replace(' ', ':') if ':' not in kind else kind}>>").json(path).select(F.inline("records"))


def write_records(rows: DataFrame, path: str, **stats) -> None:
    """Records as JSON lines in ``path/records``; their number and the statistics as one line in ``path/stats``."""
    rows.write.mode("overwrite").json(f"{path}/records")
    total = read_records(rows.sparkSession, path, rows.schema).agg(F.count("*").alias("total"))
    named = F.create_map(*[F.lit(str(x)) for p in stats.items() for x in p]) if stats else F.lit(None).cast("map<string,string>")
    total.withColumn("stats", named).write.mode("overwrite").json(f"{path}/stats")


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/records")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("total long, stats map<string,string>").json(f"{path}/stats")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log; lines that aren't JSON are left out."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def richest(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """The first of the paths that can be read: later stages' results stand before earlier ones'."""
    for path in paths:
        try:
            return spark.read.format(fmt).load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {paths}")


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache table, empty where there is none yet; files that can't be read hold nothing."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def collect_sources(sources: dict[str, Callable[[], DataFrame]], enabled: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of the enabled sources and what became of each; one that fails doesn't stop the others.

    Each source is read to its end and written to the shared folder at once, so that one that fails only when its rows are
    made is left out too, and none of its rows get into the union.
    """
    frames, status = [], {}
    for name in enabled:
        if name not in sources:
            raise KeyError(f"no source is called {name}")
        try:
            rows = sources[name]().withColumn("source_id", F.lit(name))
            path = f"{shared_folder(rows.sparkSession)}/source-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            frames.append(rows.sparkSession.read.schema(rows.schema).parquet(path))
            status[name] = "ok"
        except Exception as e:  # a source's own failure is a status
            status[name] = f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"[:200]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), status


def valid_records(rows: DataFrame) -> DataFrame:
    """Rows with a name; a website that isn't one becomes null."""
    return rows.where(F.length(F.trim("name")) > 0).withColumn("website", F.when(F.startswith("website", F.lit("http")), F.col("website")))


def as_map_document(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON document ``{key: value}`` of a list of a set size."""
    return rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), value)))).alias("document"))


def as_features(rows: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature for each row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
