"""Substring deduplication by hashing units of text.

A text is cut into units: its lines (or paragraphs), and, since shared passages often begin and end within a line, the
sentences of each line, where sentences of fewer than ``MIN_WORDS`` words join the one that follows, and lines of fewer
join a following line that is as short. A unit is normalised (lower case, words of letters and digits with single
spaces) and digested. Over all documents the digests are counted and each keeps its first occurrence, by document id
and then by place; the other occurrences are removed, with the offsets that they had in the text: what is kept and the
removed spans, put together, are the text again. Units of fewer than ``min_words`` words stay; in scripts that are
written without spaces, two characters count as a word and each character is normalised by itself.

Passages without sentence marks in reach (tables, shouted lines) are long units; a unit of more than ``SPLIT`` words is
cut after each word whose hash says so, about every eighth, so that equal passages are cut alike wherever they stand.

Defined results: null and empty texts have no units and are kept as they are. Of repeated rows the first keeps its
units; among rows of equal id (or null ids, which come last) the text's hash decides, and equal rows lose none between
them. Texts that lose everything stay as empty texts. Empty tables give no rows. Other columns are kept as they are,
whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, emptied, released, slices, staged

SLICE, SPLIT, MIN_WORDS = 1 << 20, 24, 5
#: Blocks of the scripts that put no spaces between words (Thai to Khmer, Japanese, Chinese).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
LINE, PARAGRAPH, STOP = re.compile(r"\n+"), re.compile(r"\n\s*\n"), re.compile(r"[.!?]\s+|[\u3002\uff01\uff1f]\s*")
UNSPACED, WORD, GAP = re.compile(f"[{_UNSPACED}]"), re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+"), re.compile(rf"[{_UNSPACED}]\s*|[^\s{_UNSPACED}]+\s*")


def units(text: str, kind: str = "sentence") -> list[tuple[int, int]]:
    """Begin and end of the units of ``text``: they touch or leave only white space between them."""
    out, begin = [], 0
    spaced = UNSPACED.search(text) is None
    short = None  # where a run of short lines begins that is no unit yet
    for m in [*(PARAGRAPH if kind == "paragraph" else LINE).finditer(text), None]:
        end = m.start() if m else len(text)
        if end > begin:
            if kind != "sentence":
                out.append((begin, end))
            elif _words(text, begin, end, spaced) < MIN_WORDS:
                short = begin if short is None else short
                if not m or _words(text, short, end, spaced) >= MIN_WORDS:
                    out.append((short, end))
                    short = None
            else:
                if short is not None:
                    out.append((short, last))
                    short = None
                _sentences(text, begin, end, spaced, out)
            last = end
        begin = m.end() if m else end
    if short is not None:
        out.append((short, last))
    return out


def _words(text: str, begin: int, end: int, spaced: bool) -> int:
    """About how many words there are, by the spaces; in other scripts two characters are one."""
    n = text.count(" ", begin, end) + text.count("\n", begin, end) + 1
    return n if spaced else n + len(UNSPACED.findall(text, begin, end)) // 2


def _sentences(text: str, begin: int, end: int, spaced: bool, out: list[tuple[int, int]]) -> None:
    """The sentences of a line, short ones joined to the next and long ones cut; adds them to ``out``."""
    for stop in [*(m.end() for m in STOP.finditer(text, begin, end)), end]:
        words = _words(text, begin, stop, spaced) - 1
        if stop > begin and (words >= MIN_WORDS or stop == end):
            if words >= SPLIT:
                _cut(text, begin, stop, out)
            else:
                out.append((begin, stop))
            begin = stop


def _cut(text: str, begin: int, end: int, out: list[tuple[int, int]]) -> None:
    """A long unit in pieces that end with words whose hash is 0 modulo 8, if the piece isn't short."""
    at, words = begin, 0
    for m in GAP.finditer(text, begin, end):
        words += 2 if m.end() - m.start() > 1 or m.group() < "\u0e00" else 1
        if words >= 2 * MIN_WORDS and zlib.crc32(m.group().strip().lower().encode()) % 8 == 0:
            out.append((at, m.end()))
            at, words = m.end(), 0
    if at < end:
        out.append((at, end))


def digest(unit: str) -> tuple[int, int, int]:
    """Two halves of a 128-bit digest of the normalised unit, and its number of words."""
    words = WORD.findall(unit.lower())
    value = xxhash.xxh3_128_intdigest(" ".join(words).encode())
    n = len(words) if unit.isascii() else len(words) - (len(UNSPACED.findall(unit)) + 1) // 2
    return (value >> 64) - (1 << 63), (value & 0xFFFFFFFFFFFFFFFF) - (1 << 63), n


def _listed(docs: DataFrame, kind: str, min_words: int) -> DataFrame:
    """``key, tie, begin, end, high, low`` of every unit that has enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            row, begin, end, high, low = [], [], [], [], []
            for k, text in enumerate(column(batch, "text").to_pylist()):
                for a, b in units(text or "", kind):
                    x, y, words = digest(text[a:b])
                    if words >= min_words:
                        row.append(k), begin.append(a), end.append(b), high.append(x), low.append(y)
            at = pa.array(row, pa.int64())
            numbers = [pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays([column(batch, "key").take(at), column(batch, "tie").take(at), *numbers], ["key", "tie", "begin", "end", "high", "low"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, tie long, begin int, end int, high long, low long")


def removed_spans(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, tie, spans``: for documents that lose units, the begins and ends in the text, in order, as they were.

    Only digests and places are shuffled. The first occurrence of a digest comes from a grouped minimum, which is taken
    before the shuffle too; units of digests that occur once are dropped by the join before anything is gathered.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"), F.col(text_col).cast("string").alias("text"))
    held: list[tuple[str, DataFrame]] = []
    listed = staged(_listed(rows, kind, min_words), held)
    order = F.struct(F.col("key").isNull(), "key", "tie", "begin")
    firsts = listed.groupBy("high", "low").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    repeated = staged(firsts)
    released(docs.sparkSession)
    again = listed.join(repeated, ["high", "low"]).where(~order.eqNullSafe(F.col("first"))).select("key", "tie", "begin", "end")
    spans = again.groupBy("key", "tie").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    spans = staged(spans.withColumnRenamed("key", id_col))
    emptied(held)
    return spans


def remove_repeats(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated units cut out of the text, and ``removed_spans``: where they were in the text before.

    A column of that name in the input is replaced; helper columns have names that no input has.
    """
    docs = docs.drop("removed_spans")
    key, tie, held_tie = (f"{n}_{uuid.uuid4().hex}" for n in ("key", "tie", "held"))
    spans = removed_spans(docs, kind, min_words, id_col, text_col).withColumnsRenamed({id_col: key, "tie": tie, "spans": "removed_spans"})
    held = docs.withColumn(held_tie, F.xxhash64(F.col(text_col).cast("string")))
    joined = held.join(spans, held[id_col].eqNullSafe(spans[key]) & (held[held_tie] == spans[tie]), "left").drop(key, tie, held_tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(column(batch, "removed_spans").to_pylist()):
                if spans:
                    kept, begin = [], 0
                    for span in spans:
                        kept.append(texts[k][begin : span["begin"]])
                        begin = span["end"]
                    texts[k] = "".join([*kept, texts[k][begin:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return joined.mapInArrow(run, joined.schema)
