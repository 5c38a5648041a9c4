"""Ingest of event lines as a stream: every batch is written under its number, so a batch that runs again replaces itself.

``lines/batch=N`` has what was read, once, split by whether a line could be parsed: broken lines are kept as they are.
``audit/batch=N`` has one row that tells how much of each, counted by the very write; it is written last and makes the
batch visible. Readers see the batches that have it, so one that failed half way shows nothing, and when the stream
goes on after a failure with its checkpoint, the same batch is written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.files import EVENT

AUDIT = "batch long, n_lines long, n_events long, n_rejected long, first_ts timestamp, last_ts timestamp, at timestamp"


def parsed(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """``value, event, rejected, received_at`` of text lines: those that aren't an object of JSON are rejected, blank ones left out."""
    told = F.from_json("value", f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    rows = lines.where(F.length(F.trim("value")) > 0).withColumn("event", told)
    rejected = F.col("event").isNull() | F.col("event.__broken").isNotNull() | ~F.startswith(F.trim("value"), F.lit("{"))
    return rows.select("value", F.when(~rejected, F.col("event").dropFields("__broken")).alias("event"), rejected.alias("rejected"), F.current_timestamp().alias("received_at"))


def write_batch(lines: DataFrame, batch: int, path: str, schema: str = EVENT) -> None:
    """One batch of text lines, and its audit row."""
    counted = Observation()
    known = F.col("event.ts")
    rows = parsed(lines, schema).observe(counted, F.count("*").alias("n"), F.count_if("rejected").alias("bad"), F.min(known).alias("first"), F.max(known).alias("last"))
    rows.write.mode("overwrite").partitionBy("rejected").parquet(f"{path}/lines/batch={batch}")
    write_audit(lines.sparkSession, path, batch, counted.get)


def write_audit(spark: SparkSession, path: str, batch: int, counts: dict) -> None:
    row = (batch, counts["n"], counts["n"] - counts["bad"], counts["bad"], counts["first"], counts["last"], None)
    audit = spark.createDataFrame([row], AUDIT).withColumn("at", F.current_timestamp())
    audit.coalesce(1).write.mode("overwrite").parquet(f"{path}/audit/batch={batch}")


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str, files_at_once: int = 100, schema: str = EVENT) -> StreamingQuery:
    """Take in all files of lines that are in ``source`` and were not yet taken; ends when there are no more."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(source)
    writer = lines.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path, schema))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit(spark: SparkSession, path: str) -> DataFrame:
    """A row for each batch that is whole."""
    return spark.read.schema(AUDIT).parquet(f"{path}/audit")


def _visible(spark: SparkSession, path: str, rejected: bool, schema: str) -> DataFrame:
    kinds = f"value string, event struct<{schema}>, received_at timestamp, batch long, rejected boolean"
    rows = spark.read.schema(kinds).option("basePath", f"{path}/lines").parquet(f"{path}/lines").where(F.col("rejected") == rejected)
    return rows.join(audit(spark, path).select("batch"), "batch", "left_semi")


def events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """The events of whole batches, with when they came in and their batch."""
    return _visible(spark, path, False, schema).select("event.*", "received_at", "batch")


def rejects(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """The broken lines of whole batches, as they were."""
    return _visible(spark, path, True, schema).select("value", "received_at", "batch")
