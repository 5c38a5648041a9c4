"""Ranked lexical search of many items at once: a join that is seeded with thresholds.

Only the items' terms are indexed: a posting has a document's row, its number of terms, the term and how often it
stands there. Document frequencies, the number of documents and of all terms come from the whole table. For every term
the ``k`` postings of highest impact are kept, found by a window whose limit also works before the shuffle. They give

* the kth impact: at least ``k`` documents reach it, so an item's kth score is no less, for each of its terms;
* seeds: the documents of those postings, scored exactly; the kth best of them raises the item's threshold.

Impacts fall with the length of the document, so bounds are kept for bands of lengths. In each band an item's terms are
put in order of their bounds, and the last ones, whose bounds add up to less than ``SHARE`` of the threshold, generate
no candidates: documents that have them alone can't be among the first ``k``. The other terms do: their impacts are
added for each document, and a document stays if that and the bounds of the terms left out reach the threshold.
Candidates are then scored exactly, by all terms. Nothing is lost: thresholds are scores that ``k`` documents are known
to have, and equal scores pass. A lower ``SHARE`` reads more postings and leaves fewer candidates.

Defined results: null, empty and punctuation-only texts have no terms; such documents aren't counted, and such items
have no rows. Every row of the documents is a document of its own, whatever its id: repeated rows all rank; null ids
come last among equal scores. Rows of one item id are one item (its terms are added up); without an id nothing is
asked. Long texts are read whole.
Empty tables give no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, cut, slices, staged

SLICE = 1 << 20
#: The most rows of a table to broadcast: their number is counted first, and a shuffled join takes what is larger.
FEW = 1 << 18
#: Bands of document lengths for each doubling, and the part of the threshold up to which bounds of left-out terms add up.
BANDS, SHARE = 2, 0.25
#: Letters in lower case, digits and all that isn't ASCII stay; everything else separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, with their repeats, as UTF-8."""
    return (text or "").encode().translate(FOLD).split()


def _postings(rows: DataFrame, wanted: set[bytes] | None) -> DataFrame:
    """``row, key, n, term, tf`` of each wanted term of each text, and once with a null term for every text with any term."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in slices(batches, "text", SLICE):
            at, many, term, tf = [], [], [], []
            for k, text in enumerate(column(batch, "text").to_pylist()):
                words = terms(text)
                if words:
                    counts = Counter(words if wanted is None else filter(wanted.__contains__, words))
                    at += [k] * (len(counts) + 1)
                    many += [len(words)] * (len(counts) + 1)
                    term.append(None)
                    term += counts
                    tf.append(0)
                    tf += counts.values()
            taken = pa.array(at, pa.int64())
            numbers = pa.array(many, pa.int64()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "row").take(taken), column(batch, "key").take(taken), *numbers], ["row", "key", "n", "term", "tf"])

    return rows.mapInArrow(run, f"row long, key {rows.schema['key'].dataType.simpleString()}, n long, term string, tf long")


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _first(df: DataFrame, k: int, of: str, *order: Column) -> DataFrame:
    """The first ``k`` rows of each ``of``, and their ``rank``; no task sends more than ``k`` rows of one."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, doc_id, score``: the ``k`` best documents of each item, under the names ``item_col`` and ``id_col``."""
    asked = _postings(items.select(F.lit(0).cast("long").alias("row"), F.col(item_col).alias("key"), F.col(item_text).cast("string").alias("text")), None)
    asked = cut(asked.where("term IS NOT NULL AND key IS NOT NULL").groupBy(F.col("key").alias("item"), "term").agg(F.sum("tf").alias("times")))
    vocabulary = asked.select("term").distinct()
    few = vocabulary.count() <= FEW
    wanted = {r["term"].encode() for r in vocabulary.collect()} if few else None
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    index = staged(_postings(rows, wanted))
    total = index.where("term IS NULL").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    found = index.where("term IS NOT NULL")
    if not few:
        found = found.join(vocabulary, "term", "left_semi")
    weight = F.floor(1000 * F.log((2.0 * total["n"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = cut(found.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).where("w > 0"))
    m = F.expr(f"75L + ((25L * n * {total['n']}L) div {max(1, total['l'])}L)")
    impact = F.expr("w * ((1000000000L * tf) div (1000L * tf + 12L * m))")
    hits = found.join(_small(weights), "term").withColumn("m", m).select("row", "key", "term", F.floor(BANDS * F.log2("m")).cast("int").alias("band"), impact.alias("impact"))

    best = cut(_first(hits.select("term", "impact", "row"), k, "term", F.desc("impact"), F.asc("row")))
    kth = best.groupBy("term").agg(F.when(F.count("*") >= k, F.min("impact")).otherwise(0).alias("kth"))
    asked = cut(asked.join(kth, "term"))
    seeds = _scored(asked.join(best, "term").select("item", "row").distinct(), hits, asked)
    seeds = _first(seeds, k, "item", F.desc("score"), F.asc("row")).groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(1).alias("seed"))
    floor = asked.groupBy("item").agg(F.max(F.col("times") * F.col("kth")).alias("kth_bound")).join(seeds, "item", "left")
    floor = floor.select("item", F.greatest(F.lit(1), F.col("kth_bound"), F.coalesce("seed", F.lit(1))).alias("threshold"))

    bounds = cut(hits.groupBy("term", "band").agg(F.max("impact").alias("high")))
    rising = Window.partitionBy("item", "band").orderBy(F.col("times") * F.col("high"), "term").rowsBetween(Window.unboundedPreceding, 0)
    summed = asked.join(bounds, "term").join(floor, "item").withColumn("upto", F.sum(F.col("times") * F.col("high")).over(rising))
    left_out = summed.groupBy("item", "band").agg(F.coalesce(F.max(F.when(F.col("upto") < SHARE * F.col("threshold"), F.col("upto"))), F.lit(0)).alias("rest"))
    essential = cut(summed.where(F.col("upto") >= SHARE * F.col("threshold")).join(left_out, ["item", "band"]).select("item", "band", "term", "times", (F.col("threshold") - F.col("rest")).alias("need")))
    partial = hits.join(_small(essential), ["term", "band"]).groupBy("item", "row").agg(F.sum(F.col("times") * F.col("impact")).alias("partial"), F.first("need").alias("need"))
    ranked = _scored(partial.where("partial >= need").select("item", "row"), hits, asked)
    ranked = _first(ranked.where("score > 0"), k, "item", F.desc("score"), F.asc_nulls_last("key"), F.asc("row"))
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("key").alias(id_col), "score")


def _scored(pairs: DataFrame, hits: DataFrame, asked: DataFrame) -> DataFrame:
    """``item, row, key, score`` of the pairs ``item, row``, by all terms of the item."""
    pairs = _small(cut(pairs))
    added = hits.join(pairs, "row").join(_small(asked.select("item", "term", "times")), ["item", "term"])
    return added.groupBy("item", "row").agg(F.first("key").alias("key"), F.sum(F.col("times") * F.col("impact")).alias("score"))
