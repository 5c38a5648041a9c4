"""Entity resolution: pairs within blocks, connected groups, and one merged record for each group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.blank import blank_to_null, has_items, has_text
from tessera.functions.text import clean_name, street_number
from tessera.session import shared_folder

# How much each source is trusted, and tags that exclude each other.
PRIORITY = {"mocofood": 5, "cafb": 4, "two11md": 3, "two11va": 3, "mdfb-find-food": 2}
EXCLUSIVE = [("walk_in", "appointment_required"), ("no_id_required", "photo_id")]


def _safe(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the letters of ``a``."""
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Classes of characters that are counted for a bound of the likeness: any would do.
CLASSES = ["e", "a", "i", "o", "n", "r", "t", "s", "l", "cu", "dg", "mhb", "pky", "fvwjqxz", "0123456789", " "]


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness 0 to 100 of two strings with their words sorted: twice the common subsequence over both lengths."""
    def one(x: str | None, y: str | None) -> float:
        x, y = (" ".join(sorted((s or "").split())) for s in (x, y))
        return 100.0 if not x and not y else 200.0 * common_subsequence(x, y) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def most_edits(a: int, b: int, least: float) -> int:
    """How many letters may be put in or left out between strings of these lengths that are at least so alike; -1: none can be."""
    if 200 * min(a, b) < least * (a + b):
        return -1
    edits = int((1 - least / 100) * (a + b) + 1e-9)
    return edits - (edits - (b - a)) % 2  # every edit changes the difference of the lengths by one


def segments(size: int, n: int) -> list[tuple[int, int]]:
    """Begin and length of ``n`` segments of a string, as equal as can be."""
    ends = [size * k // n for k in range(n + 1)]
    return [(x, y - x) for x, y in zip(ends, ends[1:])]


def segment_keys(word: str, least: float) -> tuple[list[str], list[str]]:
    """What a string is found by as the shorter of two, and what it asks for as the longer of two.

    Strings that are so alike differ by at most ``edits`` letters, so one of ``edits`` + 1 segments of the shorter stands
    in the longer as it is. Segment ``i`` needs to be looked for only where at most ``i`` edits stand before it and as
    many as there are segments after it behind it: if there are more on one side, the other has a segment of its own.
    """
    size, found, asked = len(word), set(), []
    top = int(size * (200 - least) / least + 1e-9)
    for n in {most_edits(size, b, least) + 1 for b in range(size, top + 1)} - {0}:
        found |= {f"{size}.{n}.{k}.{word[x : x + m]}" for k, (x, m) in enumerate(segments(size, n))}
    for a in range(size, 0, -1):
        n = most_edits(a, size, least) + 1
        if not n:
            break
        more = size - a
        for k, (x, m) in enumerate(segments(a, n)):
            behind = n - 1 - k
            for at in range(max(0, x - k, x + more - behind), min(size - m, x + k, x + more + behind) + 1):
                asked.append(f"{a}.{n}.{k}.{word[at : at + m]}")
    return sorted(found), sorted(set(asked))


def _keys(words: DataFrame, block: list[str], least: float) -> DataFrame:
    """``block, word, asks, key`` of distinct words, by ``segment_keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 500):  # a word has some tens to hundreds of keys
                some = batch.slice(begin, 500)
                both = [segment_keys(w, least) for w in some.column(len(block)).to_pylist()]
                row = pa.array([k for k, keys in enumerate(both) for of in keys for _ in of], pa.int64())
                asks = pa.array([side == 1 for keys in both for side, of in enumerate(keys) for _ in of], pa.bool_())
                key = pa.array([x for keys in both for of in keys for x in of], pa.string())
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in some.columns], asks, key], [*some.schema.names, "asks", "key"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{kinds}, asks boolean, key string").withColumn("key", F.xxhash64("key"))


def alike_words(words: DataFrame, block: list[str], least: float, below: float | None = None) -> DataFrame:
    """``block, word_a, word_b`` of the different ``word`` of a block whose likeness is ``least`` (70 or more) up to ``below``.

    Words meet at segments, so those that share none never do, however many a block has. Pairs whose lengths, or whose
    characters counted in classes, can't reach the likeness go before the pandas function sees the rest: the common
    subsequence has at most the lesser count of each class.
    """
    shared_folder(words.sparkSession)
    keys = _keys(words.select(*block, "word").distinct(), block, least).checkpoint()  # both sides of the join: split where a segment is crowded
    asked = keys.where("asks").select(*block, "key", F.col("word").alias("word_b"))
    size_a, size_b = F.length("word_a"), F.length("word_b")
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    everything = "".join(CLASSES)
    common = sum((F.least(count("word_a", c), count("word_b", c)) for c in CLASSES), F.least(size_a - count("word_a", everything), size_b - count("word_b", everything)))
    found = keys.where("NOT asks").select(*block, "key", F.col("word").alias("word_a")).join(asked, [*block, "key"])
    found = found.where((F.col("word_a") != F.col("word_b")) & (200 * common >= least * (size_a + size_b)))
    found = found.select(*block, F.least("word_a", "word_b").alias("word_a"), F.greatest("word_a", "word_b").alias("word_b")).distinct()
    found = found.withColumn("ratio", token_sort_ratio("word_a", "word_b")).where(F.col("ratio") >= least)
    return (found if below is None else found.where(F.col("ratio") < below)).drop("ratio")


def _keyed(records: DataFrame) -> DataFrame:
    """What decides if records are of the same place; those without zip, or without a name once it is clean, match none."""
    name = clean_name(F.col("name"))
    keyed = records.where(has_text(F.col("zip"))).select("ord", "zip", "source", name.alias("name"), street_number(F.col("address")).alias("number"), has_text(F.col("hours")).alias("timed"))
    return keyed.where(has_text(F.col("name"))).withColumn("word", F.array_join(F.sort_array(F.split("name", " ")), " "))


def pairs(records: DataFrame, threshold: float = 80.0, name_threshold: float = 92.0, fuzzy: bool = True) -> DataFrame:
    """``a, b, rule`` with a < b: all pairs of records of one zip that tell of the same place; ``links`` has no more than it takes.

    ``records``: ord, zip, name, address, source, hours. Equal clean names match unless both have hours and share their
    source; other names match by likeness alone, or by a lower likeness and an equal street number. Records without a
    name, once it is clean, match nothing. Likeness is a matter of names with their words sorted, so it is found once for
    two different ones of a zip, or of a zip and street number, and then joined to the records that have them.
    """
    keyed = _safe(_keyed(records))
    both = keyed.alias("l").join(keyed.alias("r"), ["zip", "name"]).where("l.ord < r.ord")
    exact = both.where(~(F.col("l.timed") & F.col("r.timed") & F.col("l.source").eqNullSafe(F.col("r.source")))).select(F.col("l.ord").alias("a"), F.col("r.ord").alias("b"), F.lit("name").alias("rule"))
    if not fuzzy:
        return exact
    found = [exact]
    for rule, block, least, below in (("likeness", ["zip"], name_threshold, None), ("street", ["zip", "number"], threshold, name_threshold)):
        rows = keyed.where(F.col("number").isNotNull()) if rule == "street" else keyed
        first, second = (rows.select(*block, F.col("word").alias(f"word_{s}"), F.col("name").alias(f"name_{s}"), F.col("ord").alias(f"ord_{s}")) for s in "ab")
        near = alike_words(rows, block, least, below).join(first, [*block, "word_a"]).join(second, [*block, "word_b"])
        if below is None:  # the same words in another order
            near = near.unionByName(first.withColumn("word_b", F.col("word_a")).join(second, [*block, "word_b"]).where("name_a != name_b AND ord_a < ord_b"))
        found.append(near.select(F.least("ord_a", "ord_b").alias("a"), F.greatest("ord_a", "ord_b").alias("b"), F.lit(rule).alias("rule")))
    return reduce(DataFrame.union, found)


def links(records: DataFrame, threshold: float = 80.0, name_threshold: float = 92.0, fuzzy: bool = True) -> DataFrame:
    """``a, b``: links that connect what ``pairs`` connects, about one for each record and for each two names that are alike.

    The records of a name link to the first of them; those that may not match it (they have hours and its source, as it
    has) to the first that does. Where two names are alike every record of both matches, so the records of each link to
    their first, and the firsts to each other.
    """
    keyed = _safe(_keyed(records))  # names are cleaned once, not in each of the joins below
    own = F.when(F.col("timed"), F.coalesce("source", F.lit("\0")))  # null: matches all
    stands = keyed.withColumn("own", own)
    first = stands.groupBy("zip", "name").agg(F.min_by("own", "ord").alias("first_own"), F.min("ord").alias("first"))
    aside = F.col("own").eqNullSafe(F.col("first_own")) & F.col("own").isNotNull()
    placed = _safe(stands.join(first, ["zip", "name"]).withColumn("aside", aside | (F.col("ord") == F.col("first"))))
    other = placed.where("NOT aside").groupBy("zip", "name").agg(F.min("ord").alias("other"))
    exact = placed.where("NOT aside").select(F.col("first").alias("a"), F.col("ord").alias("b"))
    exact = exact.union(placed.where("aside AND ord != first").join(other, ["zip", "name"]).select(F.col("other").alias("a"), F.col("ord").alias("b")))
    if not fuzzy:
        return exact
    found = [exact]
    for block, least, below in ((["zip"], name_threshold, None), (["zip", "number"], threshold, name_threshold)):
        rows = keyed.where(F.col("number").isNotNull()) if "number" in block else keyed
        words = rows.groupBy(*block, "word").agg(F.min("ord").alias("first"), (F.min("name") != F.max("name")).alias("several"))
        near = _safe(alike_words(rows, block, least, below))
        firsts = [words.select(*block, F.col("word").alias(f"word_{s}"), F.col("first").alias(s)) for s in "ab"]
        found.append(near.join(firsts[0], [*block, "word_a"]).join(firsts[1], [*block, "word_b"]).select("a", "b"))
        some = near.select(*block, F.col("word_a").alias("word")).union(near.select(*block, F.col("word_b").alias("word")))
        if below is None:
            some = some.union(words.where("several").select(*block, "word"))
        stars = rows.join(some.distinct(), [*block, "word"]).join(words.select(*block, "word", "first"), [*block, "word"])
        found.append(stars.where("ord != first").select(F.col("first").alias("a"), F.col("ord").alias("b")))
    return reduce(DataFrame.union, found)


def groups(links: DataFrame) -> DataFrame:
    """``ord, group``: the least record that each linked record reaches. Labels spread along links and to labels' labels
    until none changes, with a checkpoint each round."""
    both = _safe(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = _safe(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("group")).withColumnRenamed("a", "ord"))
    while True:
        heard = both.join(labels, both["b"] == labels["ord"]).groupBy("a").agg(F.min("group").alias("heard")).withColumnRenamed("a", "ord")
        spread = _safe(labels.join(heard, "ord").select("ord", F.least("group", "heard").alias("group"), F.col("group").alias("old")))
        jump = spread.select(F.col("ord").alias("group"), F.col("group").alias("further"))  # many may have one group: both sides are written, so adaptive execution can split them
        now = _safe(spread.join(jump, "group", "left").select("ord", F.least("group", F.coalesce("further", "group")).alias("group"), "old"))
        changed = not now.where("group != old").isEmpty()
        labels = now.select("ord", "group")
        if not changed:
            return labels


def survivor_order() -> list[Column]:
    """Best record of a group first: with hours, with description, with languages, fuller, of a better source, earlier."""
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), F.col("source")), F.lit(1))
    return [F.desc(has_text(F.col("hours"))), F.desc(has_text(F.col("hero_copy"))), F.desc(has_items(F.col("languages"))), F.desc("filled"), F.desc(priority), F.asc("ord")]


def ranked(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records with ``group`` (their own number when they have no partner) and ``place`` in it, 1 the survivor."""
    out = records.join(found, "ord", "left").withColumn("group", F.coalesce("group", "ord"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(*survivor_order())))


def merge(rows: DataFrame, scalars: list[str], sets: list[str], flags: list[str]) -> DataFrame:
    """One record for each group of ``ranked`` rows.

    ``guide`` is the survivor's alone, its first three steps, where the rows have one. Scalars are the first that isn't blank in survivor order; sets are united in that order; requirements leave out what
    an earlier tag excludes, the survivor's own kept as they are; flags hold if any record's does. Warnings tell of
    differing hours and of groups that ask for appointments and don't.
    """
    def first_of(c: str) -> Column:
        return F.min_by(c, F.when(blank_to_null(F.col(c)).isNotNull(), F.col("place")))

    def in_order(c: str) -> Column:
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))

    base = rows.groupBy("group").agg(
        F.min_by("ord", "place").alias("survivor"),
        F.min_by("name", "place").alias("name"),
        *[first_of(c).alias(c) for c in scalars],
        *[F.array_distinct(in_order(c)).alias(c) for c in sets],
        in_order("requirements").alias("__tags"),
        F.min_by("requirements", "place").alias("__own"),
        *([F.slice(F.min_by("guide", "place"), 1, 3).alias("guide")] if "guide" in rows.columns else []),
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags],
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"])).alias("source_ids"),
        F.count("*").alias("n_records"),
        F.count_distinct(blank_to_null(F.col("hours"))).alias("__hours"),
    )
    own = F.coalesce("__own", F.array().cast("array<string>"))
    rest = F.filter("__tags", lambda t: ~F.array_contains(own, t))
    def add(kept: Column, tag: Column) -> Column:
        bad = F.array_contains(kept, tag)
        for a, b in EXCLUSIVE:
            bad = bad | ((tag == a) & F.array_contains(kept, b)) | ((tag == b) & F.array_contains(kept, a))
        return F.when(bad, kept).otherwise(F.array_append(kept, tag))

    warnings = F.array_compact(F.array(F.when(F.col("__hours") > 1, "hours differ between sources"), F.when(F.array_contains("__tags", "walk_in") & F.array_contains("__tags", "appointment_required"), "walk-in and appointment both reported")))
    out = base.withColumns({"requirements": F.aggregate(rest, F.array_distinct(own), add), "warnings": warnings, "cross_source_count": F.size("source_ids")})
    return out.drop("__tags", "__own", "__hours")


def largest_groups(found: DataFrame, n: int = 15) -> DataFrame:
    """A dry run's report: the groups of most records."""
    return found.groupBy("group").agg(F.count("*").alias("n_records")).where("n_records > 1").orderBy(F.desc("n_records"), "group").limit(n)


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order; a key's rows are compared where they are read, not gathered."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")
