"""Contiguous shards of near-equal bytes.

Rows are put in one global order (hash of the text, then id), so that equal texts stand together. Each partition of
that order sums its bytes and rows; the sums, one small row for each partition, are turned into prefix sums, and the
order is cut at equal targets of bytes. A run of equal texts that reaches over a cut stays with the shard before it
for up to ``TOGETHER`` of a shard's target; a longer run is split, since shards must stay balanced.

Defined results: a null text has size 1 and the checksum of no bytes, as an empty text has. Null ids come first within
their text; of rows that are equal in both, the place in the input decides, so that many of them are many ranges.
Repeated rows are kept, each with a slot of its own. An empty table gives no rows. Other columns are not
read. Only fixed-size digests are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, cut

#: Share of a shard's target by which a run of equal texts may reach over the cut.
TOGETHER = 1 / 512


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``: contiguous shards, slots from 0 within each."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("key"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["hash", "crc", "size", F.col("key").asc_nulls_first(), "place"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()))
    text_key = F.struct("hash", "crc", "size")
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(text_key).alias("first"), F.max(text_key).alias("last"))
    last = ordered.join(F.broadcast(totals.select("part", "last")), "part").where(text_key == F.col("last"))
    tails = {r["part"]: r["tail"] for r in last.groupBy("part").agg(F.sum("size").alias("tail")).collect()}
    begins: dict[int, tuple[int, int, int]] = {}
    done_bytes = done_rows = run_start = 0
    before = None
    for r in sorted(totals.collect(), key=lambda r: r["part"]):  # one row for each partition
        same = before == r["first"]
        begins[r["part"]] = (done_bytes, done_rows, run_start if same else done_bytes)
        if not (same and r["first"] == r["last"]):
            run_start = done_bytes + r["bytes"] - tails[r["part"]]
        done_bytes, done_rows, before = done_bytes + r["bytes"], done_rows + r["rows"], r["last"]
    total = max(1, done_bytes)
    slack = total / shards * TOGETHER

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, run, previous = None, 0, 0, None
        for batch in batches:
            if not len(batch):
                continue
            if at is None:
                at, row, run = begins[column(batch, "part")[0].as_py()]
            size = column(batch, "size").to_numpy(zero_copy_only=False)
            keys = np.stack([column(batch, n).to_numpy(zero_copy_only=False) for n in ("hash", "crc", "size")])
            start = at + np.cumsum(size) - size
            new = np.ones(len(size), bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            new[0] = previous is not None and tuple(keys[:, 0]) != previous
            runs = np.maximum.accumulate(np.where(new, start, run))
            own, group = ((2 * x + size) * shards // (2 * total) for x in (start, runs))  # by a row's middle
            edge = (group + 1) * (total / shards)
            shard = np.minimum(np.where((own > group) & (start + size - edge <= slack) & (own == group + 1), group, own), shards - 1)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, "size"), column(batch, "crc"), pa.array(shard, pa.int32()), pa.array(np.arange(row, row + len(size)), pa.int64())],
                ["key", "size", "crc", "shard", "row"],
            )
            at, row, run, previous = int(start[-1] + size[-1]), row + len(size), int(runs[-1]), tuple(keys[:, -1])

    placed = ordered.mapInArrow(place, f"key {rows.schema['key'].dataType.simpleString()}, size long, crc long, shard int, row long")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first")))  # one row for each shard
    return placed.join(first, "shard").select(F.col("key").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot"))
