"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases: each is the shortest run that isn't in the dictionary yet, and joins
it. The set of phrases says what compression would learn from the text, so the overlap of two sets (Jaccard) is a
likeness as compressors see it. Phrases are hashed, and a fingerprint keeps the ``SIZE`` least hashes: the minimum-hash
signature. Sets of at most that many phrases are compared exactly, larger ones by an unbiased estimate.

The dictionary has every prefix of its phrases, so the longest known run at a place is found by stepping from a guess
(the length of the phrase before), not letter by letter.

Defined results: null and empty texts have no phrases; two such fingerprints have likeness 1, and 0 to any other.
Equal texts have equal fingerprints. The next document goes by descending id, rows of one id by the text's hash, null
ids last; the last is followed by the first, a single row by itself. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessera.llm.common import column

#: Hashes in a signature; an odd multiplier whose powers, and their inverses, hash runs of a text modulo 2**64.
SIZE, BASE = 128, 0x5851F42D4C957F2D
#: Characters of text in a range of ids.
RANGE = 8 << 20
_INVERSE = pow(BASE, -1, 1 << 64)


def phrases(text: str, known: set[str], begin: int, until: int, length: int = 4) -> tuple[list[int], int]:
    """Ends of the phrases of ``text`` that begin in ``begin`` to ``until`` - 1; adds them to ``known``.

    The last phrase of the text may be one that is known already. ``length`` is a guess; also gives back the last
    phrase's length.
    """
    ends, n, learn = [], len(text), known.add
    tell = ends.append
    while begin < until:
        end = begin + length
        run = text[begin:end]
        if run in known:
            while end < n:
                end += 1
                run = text[begin:end]
                if run not in known:
                    break
        else:
            while end > begin + 1 and (less := text[begin : end - 1]) not in known:
                end -= 1
                run = less
        learn(run)
        length = len(run)
        begin += length
        tell(begin)
    return ends, length


class Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = 2 * n + 1024
            cls.up, cls.down = (np.cumprod(np.append(np.uint64(1), np.full(size, b, np.uint64))) for b in (BASE, _INVERSE))
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(text: str, ends: list[int]) -> np.ndarray:
    """A 64-bit hash of each of the adjoining runs of ``text`` that end at ``ends``; equal runs have equal hashes."""
    if not ends:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = Powers.upto(len(codes))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes + np.uint64(0x9E3779B97F4A7C15)) * up[: len(codes)])])
    end = np.array(ends, np.int64)
    begin = np.concatenate([[0], end[:-1]])
    return _mix((sums[end] - sums[begin]) * down[begin])


def signature(hashes: np.ndarray) -> np.ndarray:
    hashes = np.unique(hashes >> np.uint64(32)).astype(np.uint32)
    return hashes[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of the sets behind two signatures: the share of their union's least hashes in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]
    rank = np.arange(1, len(both)) - np.cumsum(again)  # of the hash that comes again, among the union's from 0
    return float(np.count_nonzero(again & (rank < SIZE))) / min(SIZE, len(both) - int(np.count_nonzero(again)))


def fingerprint(text: str) -> np.ndarray:
    ends, _ = phrases(text, set(), 0, len(text))
    return signature(run_hashes(text, ends))


def fingerprint_edited(text: str, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text``, and of it with its last third (rounded down) replaced by ``tail``.

    Both texts begin alike, so the phrases that end before the edit are parsed and hashed once.
    """
    keep = len(text) - len(text) // 3
    known: set[str] = set()
    ends, length = phrases(text, known, 0, max(0, keep - 1))
    if ends and ends[-1] >= keep:  # this phrase reaches into what the edit replaces
        new, end = len(known) == len(ends), ends.pop()  # only a text's last phrase can be one that was known before
        if new:
            known.discard(text[ends[-1] if ends else 0 : end])
    begin = ends[-1] if ends else 0
    after, edited = text[begin:], text[begin:keep] + tail
    rest, _ = phrases(edited, set(known), 0, len(edited), max(1, length))
    whole, _ = phrases(after, known, 0, len(after), max(1, length))
    alike = run_hashes(text[:begin], ends)
    return signature(np.concatenate([alike, run_hashes(after, whole)])), signature(np.concatenate([alike, run_hashes(edited, rest)]))


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The documents in ranges of ids (``part``, from -1 for null ids) and how many ranges there may be, each range with the first of the range below as its last row (``ghost``).

    Ranges are cut at quantiles of the ids, which are numbers; ids and lengths alone are read for that. There is a range
    for every ``RANGE`` characters of text, so that no task's share grows with the table, and each range is a partition.
    What comes to the driver is a row for each range.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    held = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(1, -(-held // RANGE))
    cuts = docs.select(F.percentile_approx(id_col, [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []
    cuts = np.array(sorted(set(cuts)))

    @F.pandas_udf(IntegerType())
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy()).astype(np.int32))

    part = F.when(F.col("key").isNull(), -1).otherwise(range_of(F.coalesce(F.col("key"), F.lit(0))))
    rows = rows.withColumn("part", part)
    top = rows.groupBy("part").agg(F.max("key").alias("key"))
    tops = {r["part"]: r["key"] for r in top.collect()}
    parts = sorted(tops, reverse=True)  # descending ids
    above = {b: a for a, b in zip(parts, parts[1:] + parts[:1], strict=True)}
    if not parts:
        return rows.withColumn("ghost", F.lit(False)), 1
    small = spark.createDataFrame([(b, tops[b], above[b]) for b in parts], f"part int, top {rows.schema['key'].dataType.simpleString()}, above int")
    heads = rows.join(F.broadcast(small), "part").where(F.col("key").eqNullSafe(F.col("top")))
    heads = heads.groupBy("above").agg(F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    ghosts = heads.select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "text", F.col("above").alias("part"), F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts), len(cuts) + 2


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and how alike they are.

    The edited text has its last third (rounded down) replaced by as many first code points of the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_before = key_before = made = None  # the row that needs the next text; the one that needs the next fingerprint
        out: list[tuple] = []

        def give() -> pa.RecordBatch:
            kinds = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)
            out.clear()
            return batch

        def tell(row: tuple, following: np.ndarray) -> None:
            key, n, digest, own, edited = row
            out.append((key, n, digest, own.astype(">u4").tobytes().hex(), edited.astype(">u4").tobytes().hex(), likeness(own, edited), likeness(own, following)))

        for batch in batches:
            key_type = column(batch, "key").type
            for key, text, ghost in zip(*(column(batch, c).to_pylist() for c in ("key", "text", "ghost")), strict=True):
                if text_before is not None:
                    tail = text[: len(text_before) // 3]
                    own, edited = fingerprint_edited(text_before, tail)
                    if made is not None:
                        tell(made, own)
                    keep = len(text_before) - len(text_before) // 3
                    made = (key_before, len(text_before), hashlib.sha256((text_before[:keep] + tail).encode()).hexdigest(), own, edited)
                if ghost:
                    if made is not None:
                        tell(made, fingerprint(text))
                    text_before = made = None
                else:
                    text_before, key_before = text, key
                if len(out) >= 1000:
                    yield give()
        if out:
            yield give()

    rows, parts = _neighbours(docs, id_col, text_col)
    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.repartitionById(parts, F.col("part") + 1).sortWithinPartitions("part", "ghost", F.col("key").desc_nulls_last(), F.xxhash64("text").desc(), F.col("text").desc())
    out = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, out).withColumnRenamed("key", id_col)


NAMES = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
