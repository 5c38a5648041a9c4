"""What several of the text operators share: UTF-8 buffers, bounded slices of Arrow batches, checkpoints."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute in all modules
from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder, so that a lost executor costs no recomputation of what led to it.

    The folder is the one that ``spark.checkpoint.dir`` names; only where nothing is set and all runs on one machine (as in
    tests) a temporary one is made. On a cluster without that setting this is an error.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    shared_folder(spark)


def staged(df: DataFrame, until: list[tuple[str, DataFrame]] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``cut``, but smaller on disk and read by column.

    With ``until``, the table is put in that list for ``emptied``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if until is not None:
        until.append((path, table))
    return table


def emptied(tables: list[tuple[str, DataFrame]]) -> None:
    """Remove staged tables that nothing will read again, and forget them.

    The shuffle files of the steps that are done go when the driver collects its garbage, so it is asked to.
    """
    if not tables:
        return
    spark = tables[0][1].sparkSession
    for path, _ in tables:  # without a job for each, of which the driver keeps a record
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    tables.clear()
    released(spark)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files and broadcasts that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row begins (one more entry than rows). Null: empty."""
    array = array.cast(pa.large_string()).fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches again in runs of rows whose texts hold at most ``limit`` bytes together (or one longer row)."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(column(batch, text)).fill_null(0), dtype=np.int64)
        begin, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each of the lengths, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)
