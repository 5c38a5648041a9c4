"""Collocations: frequent phrases of neighbouring words, mined by partitioning at pivots.

Every n-gram is owned by its rarest word, the pivot. A text is rewritten for each occurrence of a word: what remains are
the words around it that an n-gram with this pivot can hold, up to the next rarer word or the end of the piece. To the
left the fragment also ends at the same word, so an n-gram that has its pivot twice belongs to the first of the two.
Equal fragments are added up in the task, and all of a pivot are sent to one place, which counts the n-grams that it owns
and tells those that are frequent. A pivot that occurs more than ``SHARE`` times is dealt to several places, whose counts
are added up after. Which places they are follows from the order of the rows read, so a task that runs again deals alike.

Words are numbered, frequent ones first. The numbers of the first ``KNOWN`` are broadcast; the words after those are told
from infrequent ones by a bitmap of fixed size (it may let an infrequent word through, whose n-grams are then dropped by
their counts) and have a number of 61 bits from a hash, so that nothing that is sent to all tasks grows with the corpus.

A phrase of two or more words is cut after each word; the score of a cut compares the phrase's count with those of the
two parts, and the lowest counts. A phrase within a longer one of the same count is dropped. Both are joins of the frequent
phrases with themselves; counts of a phrase's parts are never less than its own, so all parts are there.

Defined results: null and empty texts have no words. Rows without a language are one language, ``und``, together with
those that have that name. Repeated rows count as often as they stand there. Phrases of equal score and count are ordered
by their bytes. Long texts are read whole, a piece at a time. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, slices, staged

SLICE, LONGEST = 1 << 21, 5
#: Words whose numbers are broadcast; bits of the map of the other frequent words; words counted before a task tells them.
KNOWN, BITS, HELD = 1 << 18, 1 << 27, 1 << 19
#: Occurrences of a pivot that go to one place, and bytes that a place mines at once.
SHARE, MINED = 1 << 17, 1 << 22
#: A-Z in lower case; all that ends a piece is a full stop; a tab is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, with ``b"."`` between pieces, in runs that end with pieces."""
    raw, begin = (text or "").encode().translate(FOLD), 0
    while begin < len(raw):
        end = raw.find(b".", begin + SLICE) + 1 or len(raw)
        yield raw[begin:end].replace(b".", b" . ").split()
        begin = end


def _counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n``: a task's counts of its words, and under a null word of all of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def told() -> pa.RecordBatch:
            langs = [lang for lang, of in counts.items() for _ in range(len(of) + 1)]
            words = [w for of in counts.values() for w in (None, *of)]
            n = [x for of in counts.values() for x in (of.total(), *of.values())]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in slices(batches, "text", SLICE):
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                of = counts.setdefault(lang, Counter())
                for words in tokens(text):
                    of.update(words)
                    of.pop(b".", None)
            if sum(map(len, counts.values())) > HELD:
                yield told()
                counts.clear()
        yield told()

    return rows.mapInArrow(run, "lang string, word string, n long")


def _hashed(lang: str, word: bytes) -> int:
    """What ``xxhash64(lang, word)`` gives, cut to 61 bits."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), 42)) & (1 << 61) - 1


class Codes(dict):
    """Numbers of the words of a language: those that are broadcast, then, above ``top``, by hash; 0 for infrequent ones."""

    def __init__(self, lang: str, known: dict[bytes, int], top: int, bits: np.ndarray | None):
        super().__init__(known)
        self.lang, self.top, self.bits = lang, top, bits
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        if self.bits is None:
            return 0
        h = _hashed(self.lang, word)
        return h + self.top + 1 if self.bits[h % BITS >> 3] >> (h & 7) & 1 else 0


def fragments(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of numbered words (0: none), for each word: its place, how many on the left and on the right its n-grams can hold."""
    at = np.flatnonzero(code)
    own = code[at]
    padded = np.concatenate([np.zeros(LONGEST, code.dtype), code, np.zeros(LONGEST, code.dtype)])
    left, right = np.zeros(len(at), np.int8), np.zeros(len(at), np.int8)
    on_left, on_right = np.ones(len(at), bool), np.ones(len(at), bool)
    for step in range(1, LONGEST):
        x, y = padded[at + LONGEST - step], padded[at + LONGEST + step]
        on_left &= (x > 0) & (x < own)
        on_right &= (y > 0) & (y <= own)
        left += on_left
        right += on_right
    return at, padded, left, right


def _fragments(rows: DataFrame, known: dict[str, dict[bytes, int]], parts_of: np.ndarray, rest: int, bits: np.ndarray | None) -> DataFrame:
    """``pivot, part, sides, words, times``: the fragments of a pivot in a batch of texts, each with the number of its copies.

    ``parts_of`` has the number of parts of the known pivots, ``rest`` that of every other.
    """
    shared = rows.sparkSession.sparkContext.broadcast((known, parts_of, bits))
    kind = np.int32 if bits is None else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts_of, bits = shared.value
        top = len(parts_of)
        codes = {lang: Codes(lang, of, top, bits) for lang, of in known.items()}
        turn = TaskContext.get().partitionId()
        for batch in slices(batches, "text", SLICE):
            found = []
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                of = codes[lang] if lang in codes else codes.setdefault(lang, Codes(lang, {}, top, bits))
                for words in tokens(text):
                    found += [np.fromiter(map(of.__getitem__, words), kind, len(words)), np.zeros(1, kind)]
            if not found:
                continue
            at, padded, left, right = fragments(np.concatenate(found))
            some = left + right > 0
            at, left, right = at[some], left[some], right[some]
            wide = np.stack([np.where((-left <= k) & (k <= right), padded[at + LONGEST + k], 0) for k in range(1 - LONGEST, LONGEST)], axis=1)
            wide, times = _distinct(wide)
            pivot = wide[:, LONGEST - 1].astype(np.int64)
            first = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])[: len(pivot)])
            filled = wide > 0
            sides = (filled[:, : LONGEST - 1].sum(axis=1) * LONGEST + filled[:, LONGEST:].sum(axis=1)).astype(np.int8)
            kept = filled.copy()
            kept[:, LONGEST - 1] = False  # the pivot is told once for all
            ends = np.append(first, len(pivot))
            sizes = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])[ends] * wide.itemsize
            pivots = pivot[first]
            parts = np.append(parts_of, rest)[np.minimum(pivots - 1, top)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(pivots),
                    pa.array((turn % parts).astype(np.int32)),
                    _blobs(sides, ends),
                    _blobs(wide[kept], sizes),
                    _blobs(times.astype(np.int32), ends * 4),
                ],
                ["pivot", "part", "sides", "words", "times"],
            )
            turn += 1

    return rows.mapInArrow(run, "pivot long, part int, sides binary, words binary, times binary")


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values``, cut at ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _distinct(wide: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, in the order of their middle, and how often they stand there (or their weights added up)."""
    mixed = np.zeros(len(wide), np.uint64)
    for k in range(wide.shape[1]):
        mixed = (mixed ^ wide[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((mixed, wide[:, wide.shape[1] // 2]))
    wide = wide[order]
    new = np.append(True, (wide[1:] != wide[:-1]).any(axis=1))[: len(wide)]  # two rows of one hash may alternate: told twice, counted right
    first = np.flatnonzero(new)
    if weights is None:
        return wide[first], np.diff(np.append(first, len(wide)))
    return wide[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)


def mined(pivot: np.ndarray, sides: np.ndarray, words: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of 2 to 5 words that the fragments' pivots own, a row of codes each (0 where shorter), and their counts.

    ``words`` has the fragments without their pivots, one after another.
    """
    left, right = sides // LONGEST, sides % LONGEST
    room = (left + right).astype(np.int64)
    wide = np.zeros((len(pivot), 2 * LONGEST - 1), np.int64)
    place = np.arange(2 * LONGEST - 1) - LONGEST + 1
    inside = (place >= -left[:, None]) & (place <= right[:, None]) & (place != 0)
    assert room.sum() == len(words)
    wide[inside] = words
    wide[:, LONGEST - 1] = pivot
    grams, counts = [], []
    for length in range(2, LONGEST + 1):
        for before in range(length):
            rows = np.flatnonzero((left >= before) & (right >= length - 1 - before))
            if len(rows):
                gram = np.zeros((len(rows), LONGEST), np.int64)
                gram[:, :length] = wide[rows, LONGEST - 1 - before : LONGEST - 1 - before + length]
                grams.append(gram), counts.append(times[rows])
    if not grams:
        return np.zeros((0, LONGEST), np.int64), np.zeros(0, np.int64)
    return _distinct(np.concatenate(grams), np.concatenate(counts))


def _mined(dealt: DataFrame, kind: type, least: int) -> DataFrame:
    """``codes, n`` of the n-grams that rows sorted by ``pivot, part`` own: the frequent ones; of pivots in several parts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def told(rows: pa.Table) -> pa.RecordBatch:
            blobs = [b"".join(rows.column(c).to_pylist()) for c in ("sides", "words", "times")]
            sides, words, times = (np.frombuffer(b, t) for b, t in zip(blobs, (np.int8, kind, np.int32), strict=True))
            many = np.asarray(pa.compute.binary_length(rows.column("sides").combine_chunks()))
            pivot = np.repeat(rows.column("pivot").to_numpy(), many)
            divided = np.repeat(rows.column("divided").to_numpy(zero_copy_only=False), many)
            grams, counts = [], []
            ends = np.concatenate([[0], np.cumsum((sides // LONGEST).astype(np.int64) + sides % LONGEST)])
            for whole in (False, True):
                chosen = divided == whole
                if chosen.any():
                    inside = np.repeat(chosen, np.diff(ends))
                    gram, count = mined(pivot[chosen], sides[chosen], words[inside], times[chosen].astype(np.int64))
                    keep = np.full(len(count), whole) | (count >= least)
                    grams.append(gram[keep]), counts.append(count[keep])
            gram, count = np.concatenate(grams), np.concatenate(counts)
            sizes = (gram > 0).sum(axis=1)
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(gram[gram > 0]))
            return pa.RecordBatch.from_arrays([codes, pa.array(count)], ["codes", "n"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.nbytes
            if size > MINED:  # up to the last whole pivot
                rows = pa.Table.from_batches(held)
                pivot = rows.column("pivot").to_numpy()
                begin = int(np.searchsorted(pivot, pivot[-1]))
                if begin:
                    yield told(rows.slice(0, begin))
                    held = rows.slice(begin).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield told(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "codes array<long>, n long")


def frequent(docs: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text", known: int = KNOWN, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, a`` of all phrases of 1 to 5 words that occur at least ``least`` times, and ``lang, n`` of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = staged(_counts(rows).groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least)))
    totals = words.where("word IS NULL").select("lang", "n")
    words = words.where("word IS NOT NULL")
    first = words.orderBy(F.desc("n"), "lang", "word").limit(known).collect()  # at most ``known`` words
    numbers: dict[str, dict[bytes, int]] = {}
    for k, r in enumerate(first):
        numbers.setdefault(r["lang"], {})[r["word"].encode()] = k + 1
    parts_of = np.array([1 + r["n"] // share for r in first], np.int64)
    numbered = staged(spark.createDataFrame([(r["lang"], r["word"], k + 1) for k, r in enumerate(first)], "lang string, word string, code long"))
    rest, bits = 1, None
    if len(first) == known:
        rest = int(parts_of[-1])  # no other word occurs more often
        hashed = F.xxhash64("lang", "word").bitwiseAND(F.lit((1 << 61) - 1))
        others = words.join(F.broadcast(numbered), ["lang", "word"], "left_anti").select("lang", "word", (hashed + known + 1).alias("code"), F.pmod(hashed, F.lit(BITS)).alias("at"))
        marks = others.select(F.shiftright("at", 3).alias("byte"), F.expr("shiftleft(1, CAST(at % 8 AS INT))").alias("bit"))
        marks = marks.groupBy("byte").agg(F.bit_or("bit").alias("bit")).toPandas()  # at most BITS / 8 rows
        bits = np.zeros(BITS >> 3, np.uint8)
        bits[marks["byte"].to_numpy(np.int64)] = marks["bit"].to_numpy(np.int64)
        numbered = numbered.unionByName(others.drop("at"))
    divided = F.col("pivot") <= int((parts_of > 1).sum())  # the first ones: they are in the order of their counts
    if rest > 1:
        divided |= F.col("pivot") > known
    dealt = _fragments(rows, numbers, parts_of, rest, bits).repartition("pivot", "part").sortWithinPartitions("pivot", "part")
    grams = _mined(dealt.select(divided.alias("divided"), "pivot", "sides", "words", "times"), np.int32 if bits is None else np.int64, least)
    grams = staged(grams.groupBy("codes").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    spelled = grams.select("codes", "a", F.posexplode("codes").alias("at", "code")).join(numbered, "code")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    phrases = spelled.groupBy("codes", "a").agg(F.first("lang").alias("lang"), F.array_join(in_order, " ").alias("phrase"))
    phrases = phrases.select("lang", "phrase", F.size("codes").alias("size"), "a")
    return phrases.unionByName(words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("a"))), totals


def score() -> Column:
    """``1000 * a * n`` by ``l * r`` without the rest, exact for products of up to 38 digits."""
    a, l, r, n = (f"CAST({c} AS DECIMAL(19, 0))" for c in "alrn")
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * ({a} * {n})) div ({l} * {r})")


def collocations(docs: DataFrame, first: int = 2000, least: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases by score."""
    found, totals = frequent(docs, least, lang_col, text_col)
    found = staged(found)
    parts = F.split("phrase", " ")
    several = found.where("size > 1")
    cuts = several.select("lang", "phrase", "a", "size", parts.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    counts = found.select("lang", "phrase", "a")
    cuts = cuts.join(counts.withColumnsRenamed({"phrase": "head", "a": "l"}), ["lang", "head"]).join(counts.withColumnsRenamed({"phrase": "tail", "a": "r"}), ["lang", "tail"]).join(F.broadcast(totals), "lang")
    lowest = cuts.withColumn("score", score()).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    within = several.where("size > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(parts, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    covered = within.groupBy("lang", "phrase").agg(F.max("a").alias("a"))  # if any longer one is as frequent, one that is a word longer is
    kept = lowest.join(covered, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "n", "low.l", "low.r", "low.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", place).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
