"""Removal of every byte that a string of ``WINDOW`` bytes covers which also starts somewhere else.

1. Anchors. Of the runs of ``SEED`` bytes in a window, the one with the least hash (the leftmost of equals) is its
   anchor. Equal windows have equal anchors at equal places, so windows can be dealt by anchor. Neighbouring windows
   with one anchor make a span; a document has a span for about every 85 bytes.
2. Counts. Spans that occur twice repeat with all their windows. Spans whose anchor has no other content repeat with
   none. Only digests and places are shuffled for this, with partial counts.
3. Collections. For what is left, the distinct spans of an anchor are the documents of a collection, built column by
   column: each round inserts one symbol of every document, from its end to its begin, into the transform of the
   collection and its common prefixes, which a task reads and writes sequentially as files of its own. A symbol is a
   word of ``WORD`` bytes (by its 64-bit hash, whose order is as good as any); a span gives one document for each way to cut it into words, so every byte starts a suffix.
   The transform is held by its occurrence lists (for each symbol, in order, the places where it stands), which make a
   rank a binary search. Where the common prefix of neighbouring suffixes has ``WINDOW`` bytes, both windows repeat.
4. An anchor with more than ``CROWD`` distinct spans (a passage that very many texts quote, each in a context of its
   own) would make a collection that grows with the corpus. Its spans are cut into parts of at most 24 windows, by how
   far these begin before the anchor, and dealt by the bytes that all windows of a part share; steps 2 and 3 follow for
   the parts. What is crowded still is cut into parts of 6, then of 1, where a part is a window and counting decides.

Defined results: null and empty texts have no bytes, so nothing is removed; texts of fewer than ``WINDOW`` bytes lose
nothing. Repeated rows are documents that repeat each other. Bytes count as equal where two 64-bit hashes of them are. Null ids are rows like others. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, ramp, slices, staged, utf8

WINDOW, SEED, WORD, CROWD = 200, 32, 25, 1000
WIDTHS = (24, 6, 1)
SLICE, BLOCK = 1 << 19, 1 << 18
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """64-bit hashes of any runs of a buffer, by prefix sums of its bytes' codes times powers of an odd base."""

    _codes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = self._powers.get(base, (np.zeros(0, np.uint64),) * 2)
        if len(up) <= len(data):
            up, self.down = self._powers[base] = tuple(np.cumprod(np.append(np.uint64(1), np.full(2 * len(data) + 1024, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._codes[data] * up[: len(data)])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys, from block-wise running minima in both directions."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the documents in ``data``: the document, first window, number of windows, anchor and digest of each span, and
    where its anchor stands in ``data``."""
    n = np.maximum(0, np.diff(offsets) - WINDOW + 1)
    if not n.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    seeds = np.arange(len(data) - SEED + 1)
    hashes = Hashes(data, _BASES[0]).of(seeds, seeds + SEED)
    keys = hashes & ~np.uint64(0xFFFFFFFF) | seeds.astype(np.uint64)
    least = _least(keys, WINDOW - SEED + 1)
    doc = np.repeat(np.arange(len(n)), n)
    window = offsets[:-1][doc] + ramp(n)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    begin = window[first]
    content = Hashes(data, _BASES[1]).of(begin, begin + count + WINDOW - 1)
    return doc[first], begin - offsets[:-1][doc[first]], count, hashes[anchor[first]], content ^ count.astype(np.uint64), anchor[first]


def _listed(docs: DataFrame) -> DataFrame:
    """``key, tie, first, count, anchor, content``: every document's distinct spans, and (without anchor) the runs of
    windows that repeat within the document, which need no look at others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            doc, first, count, anchor, content, _ = spans(*utf8(column(batch, "text")))
            own = _mix(_mix(content ^ doc.astype(np.uint64)) + anchor)
            _, keep, inverse, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(times[inverse] > 1)
            joined = np.zeros(len(again), bool)
            joined[1:] = (doc[again][1:] == doc[again][:-1]) & (first[again][1:] == first[again][:-1] + count[again][:-1])
            heads = np.flatnonzero(~joined)
            runs = np.add.reduceat(count[again], heads) if len(heads) else count[:0]
            row = pa.array(np.concatenate([doc[keep], doc[again][heads]]))
            blank = np.concatenate([np.zeros(len(keep), bool), np.ones(len(heads), bool)])
            ids = [pa.array(np.concatenate([x[keep].view(np.int64), np.zeros(len(heads), np.int64)]), mask=blank) for x in (anchor, content)]
            places = [pa.array(np.concatenate([x[keep], y]).astype(np.int32)) for x, y in ((first, first[again][heads]), (count, runs))]
            yield pa.RecordBatch.from_arrays([column(batch, "key").take(row), column(batch, "tie").take(row), *places, *ids], ["key", "tie", "first", "count", "anchor", "content"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, tie long, first int, count int, anchor long, content long")


def _range_minima(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of ``values[begin:end]`` for each pair, from a table of minima over runs of powers of two."""
    level = np.frexp((end - begin).astype(np.float64))[1] - 1
    out = np.empty(len(begin), values.dtype)
    table, k, top = values, 0, int(level.max(initial=0))
    while True:
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[begin[at]], table[end[at] - (1 << k)])
        if k == top:
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def repeated(strings: list[bytes]) -> np.ndarray:
    """Places, in the strings end to end, at which ``WINDOW`` bytes start that also start elsewhere in the collection."""
    length = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings) + b"\0" * WORD, np.uint8)
    here = np.arange(len(data) - WORD + 1)
    _, symbol = np.unique(Hashes(data, _BASES[0]).of(here, here + WORD), return_inverse=True)
    start = np.repeat(np.cumsum(length) - length, WORD) + np.tile(np.arange(WORD), len(length))
    size = np.maximum(0, (np.repeat(length, WORD) - np.tile(np.arange(WORD), len(length))) // WORD)
    m, enough = len(start), WINDOW // WORD
    place = np.arange(m)  # of each document's suffix so far; the empty suffixes come first, in the documents' order
    with tempfile.TemporaryDirectory() as folder:
        names, kinds, files = ("transform", "prefixes", "suffixes"), (np.int64, np.uint8, np.int32), None

        def read() -> list[np.ndarray]:
            """What the last round wrote; its files go, and the next round writes others."""
            if files is None:
                return [np.zeros(0, k) for k in kinds]
            values = [np.fromfile(f, k) for f, k in zip(files, kinds, strict=True)]
            for file in files:
                file.unlink()
            return values

        for back in range(1, int(size.max(initial=0)) + 1):
            transform, prefix, suffix = read()
            live = np.flatnonzero(size >= back)
            at = start[live] + WORD * (size[live] - back)
            key = symbol[at].astype(np.int64) << 32 | place[live]
            order = np.argsort(key)
            live, at, key = live[order], at[order], key[order]
            new = np.searchsorted(transform, key) + np.arange(len(key))
            old = np.ones(len(transform) + len(key), bool)
            old[new] = False
            moved = np.flatnonzero(old)
            merged = np.empty(len(old), np.int64)
            merged[new], merged[moved] = key, transform
            rest = merged & 0xFFFFFFFF
            pair = np.unique(np.concatenate([new - 1, new]))
            pair = pair[(pair >= 0) & (pair < len(merged) - 1)]
            alike = merged[pair] >> 32 == merged[pair + 1] >> 32
            same = pair[alike]
            prefixes = np.zeros(len(merged), np.uint8)
            prefixes[moved] = prefix
            prefixes[pair + 1] = 0
            before = np.concatenate([np.zeros(m, np.uint8), prefix])  # of all suffixes of the last round
            prefixes[same + 1] = np.minimum(enough, 1 + _range_minima(before, rest[same] + 1, rest[same + 1] + 1))
            now = np.concatenate([np.arange(m), m + moved])  # where the suffixes of the last round are now
            suffixes = np.empty(len(merged), np.int32)
            suffixes[new], suffixes[moved] = at, suffix
            place[live] = m + new
            files = [Path(folder, f"{name}-{back}") for name in names]
            for file, values in zip(files, (merged & ~0xFFFFFFFF | now[rest], prefixes, suffixes), strict=True):
                values.tofile(file)
        _, prefix, suffix = read()
    deep = prefix >= enough
    deep[:-1] |= deep[1:]
    return np.sort(suffix[deep]).astype(np.int64)


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of neighbouring numbers in the sorted ``at``."""
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return at[first], np.diff(np.append(first, len(at)))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``key, tie, first, count``: runs of windows that repeat, of documents ``key, tie, text, place``."""
    kind = docs.schema["key"].dataType.simpleString()
    listed = staged(_listed(docs))
    inside = listed.where("anchor IS NULL").select("key", "tie", "first", "count")
    listed = listed.where("anchor IS NOT NULL")
    contents = listed.groupBy("anchor", "content").agg(F.count("*").alias("times"))
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("contents"))
    busy = contents.join(anchors, "anchor").where("times > 1 OR contents > 1")
    members = staged(listed.join(staged(busy.select("anchor", "content", "times", "contents")), ["anchor", "content"]))
    copies = members.where("times > 1").select("key", "tie", "first", "count")

    # One member of each distinct span whose anchor has others, with the bytes from its document.
    mixed = members.where("contents > 1").groupBy("anchor", "content", "contents", "times").agg(F.min(F.struct(F.col("key").isNull(), "key", "tie", "first", "count")).alias("one"))
    wanted = mixed.select(F.col("one.key").alias("key"), F.col("one.tie").alias("tie"), F.struct("anchor", "contents", "times", F.col("one.first").alias("first"), F.col("one.count").alias("count")).alias("span"))
    wanted = wanted.groupBy("key", "tie").agg(F.collect_set("span").alias("spans"))
    equal = staged(docs.groupBy("key", "tie").agg(F.count("*").alias("rows"), F.min("place").alias("place")).where("rows > 1").drop("rows"))
    found = _with(docs, _with_place(wanted, equal), "spans", "inner")

    def fetch(crowded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SLICE):
                data, offsets = utf8(column(batch, "text"))
                lists = column(batch, "spans")
                per = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
                flat = lists.flatten()
                of = {n: np.asarray(flat.field(k)) for k, n in enumerate(("anchor", "contents", "times", "first", "count"))}
                row = np.repeat(np.arange(len(per)), per)
                chosen = np.flatnonzero((of["contents"] > CROWD) == crowded)
                row, of = row[chosen], {n: v[chosen] for n, v in of.items()}
                begin = offsets[row] + of["first"]
                raw = data.tobytes()
                parts = [raw[a : a + c + WINDOW - 1] for a, c in zip(begin.tolist(), of["count"].tolist(), strict=True)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "key").take(at), column(batch, "tie").take(at), pa.array(of["first"], pa.int32()), pa.array(of["anchor"], pa.int64()), pa.array(of["times"] == 1), pa.array(parts, pa.binary())], ["key", "tie", "first", "anchor", "single", "bytes"]
                )

        return run

    form = f"key {kind}, tie long, first int, anchor long, single boolean, bytes binary"
    built = _collected(found.mapInArrow(fetch(False), form), kind)
    return inside.union(copies).union(built).union(_crowds(found.mapInArrow(fetch(True), form).drop("anchor"), kind))


def _crowds(rows: DataFrame, kind: str) -> DataFrame:
    """Repeated windows of spans ``key, tie, first, single, bytes`` whose anchors have too many: the fourth step."""
    found = None
    for width in WIDTHS:
        parts = staged(rows.mapInArrow(_parts(width), f"key {kind}, tie long, first int, count int, anchor long, content long, single boolean, bytes binary"))
        order = F.struct(F.col("key").isNull(), "key", "tie", "first")
        one = F.min_by(F.struct("key", "tie", "first", "single", "bytes"), order)
        contents = parts.groupBy("anchor", "content").agg(F.count("*").alias("times"), one.alias("one"))
        groups = contents.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1")
        copies = parts.join(contents.where("times > 1").select("anchor", "content"), ["anchor", "content"]).select("key", "tie", "first", "count")
        mixed = staged(contents.join(groups, "anchor").select("one.*", "anchor", "contents"))
        built = _collected(mixed.where(F.col("contents") <= CROWD).select("key", "tie", "first", "anchor", "single", "bytes"), kind)
        found = copies.union(built) if found is None else found.union(copies).union(built)
        rows = mixed.where(F.col("contents") > CROWD).select("key", "tie", "first", "single", "bytes")
        if rows.isEmpty():
            break
    return found


def _parts(width: int):
    """Cut spans into parts of at most ``width`` windows that begin about equally far before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", SLICE):
            strings = column(batch, "bytes").cast(pa.large_binary())
            offsets = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(strings), dtype=np.int64))])
            data = np.frombuffer(b"".join(strings.to_pylist()), np.uint8)
            row, _, count, anchor, _, place = spans(data, offsets)
            begin = offsets[row]
            lead = place - begin  # the first window begins so far before the anchor
            high, low = lead // width, (lead - count + 1) // width
            n = high - low + 1
            of = np.repeat(np.arange(len(row)), n)
            part = high[of] - ramp(n)
            first = np.maximum(0, lead[of] - (part * width + width - 1))
            last = np.minimum(count[of] - 1, lead[of] - part * width)
            core = place[of] - part * width
            shared, whole = Hashes(data, _BASES[0]), Hashes(data, _BASES[1])
            group = _mix(anchor[of] ^ _mix(shared.of(core, core + WINDOW + 1 - width) + part.astype(np.uint64)))
            content = _mix(whole.of(begin[of] + first, begin[of] + last + WINDOW) + (lead[of] - first).astype(np.uint64))
            raw = data.tobytes()
            cut = [raw[a:b] for a, b in zip((begin[of] + first).tolist(), (begin[of] + last + WINDOW).tolist(), strict=True)]
            at = pa.array(row[of])
            keep = [column(batch, c).take(at) for c in ("key", "tie", "single")]
            places = [pa.array((np.asarray(column(batch, "first"))[row[of]] + first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*keep[:2], *places, pa.array(group.view(np.int64)), pa.array(content.view(np.int64)), keep[2], pa.array(cut, pa.binary())], ["key", "tie", "first", "count", "anchor", "content", "single", "bytes"])

    return run


def _collected(rows: DataFrame, kind: str) -> DataFrame:
    """Repeated windows of distinct spans ``key, tie, first, anchor, single, bytes``, a collection for each run of anchors."""

    def collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def resolve() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            strings = block.column("bytes").to_pylist()
            length = np.array([len(s) for s in strings], np.int64)
            ends = np.cumsum(length)
            at = repeated(strings)
            of = np.searchsorted(ends, at, side="right")
            ok = np.asarray(block.column("single"))[of]  # the others repeat as wholes, which is known
            at, of = at[ok], of[ok]
            begin, count = _runs(at + of)  # a gap between strings
            row = np.searchsorted(ends + np.arange(len(ends)), begin, side="right")
            first = np.asarray(block.column("first"))[row] + begin - row - (ends - length)[row]
            keys = [block.column(n).combine_chunks().take(pa.array(row)) for n in ("key", "tie")]
            return pa.RecordBatch.from_arrays([*keys, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["key", "tie", "first", "count"])

        last = None
        for batch in batches:  # sorted by anchor: a collection ends where an anchor ends
            if not len(batch):
                continue
            anchor = np.asarray(column(batch, "anchor"))
            sizes = np.asarray(pa.compute.binary_length(column(batch, "bytes")), dtype=np.int64)
            begin = 0
            for edge in [*(np.flatnonzero(np.diff(anchor)) + 1).tolist(), len(batch)]:
                if size >= BLOCK and anchor[begin] != last:
                    yield resolve()
                    size = 0
                held.append(batch.slice(begin, edge - begin))
                size += int(sizes[begin:edge].sum())
                last, begin = anchor[edge - 1], edge
        if held:
            yield resolve()

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(collections, f"key {kind}, tie long, first int, count int")


def _with_place(lists: DataFrame, equal: DataFrame) -> DataFrame:
    """The lists with the place of the one row that is to have each, where several rows have its key and tie."""
    equal = equal.select(F.col("key").alias("key_e"), F.col("tie").alias("tie_e"), F.col("place").alias("place_of"))
    return lists.join(equal, (F.col("tie") == F.col("tie_e")) & F.col("key").eqNullSafe(F.col("key_e")), "left").drop("key_e", "tie_e")


def _with(docs: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """Documents ``key, tie, text, place`` with the list of their key and tie (and place, if the list has one)."""
    own = (F.col("tie") == F.col("tie_of")) & F.col("key").eqNullSafe(F.col("key_of"))
    if "place_of" in lists.columns:
        own &= F.col("place_of").isNull() | (F.col("place_of") == F.col("place"))
    return docs.join(lists.withColumnsRenamed({"key": "key_of", "tie": "tie_of"}), own, how).select("key", "tie", "text", name)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, removed``: what is left of each text; ``removed`` has the
    begins and ends, in bytes of the text as it was, of the maximal runs that went."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"), F.monotonically_increasing_id().alias("place"))
    # Rows of equal id and text tell of the same runs; a set holds as many as one document has, however many rows there are.
    flags = repeated_windows(rows).groupBy("key", "tie").agg(F.collect_set(F.struct("first", "count")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = utf8(column(batch, "text"))
            lists = column(batch, "windows")
            per = np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
            flat = lists.flatten()
            first, count = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
            begin = np.repeat(offsets[:-1], per) + first
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + count + WINDOW - 1, -1)
            gone = np.cumsum(depth)[:-1] > 0
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            starts[heads] = gone[heads]
            stops = np.zeros(len(data) + 1, bool)
            stops[1:] = gone
            stops[:-1] &= ~gone
            stops[offsets[1:][np.diff(offsets) > 0]] = gone[offsets[1:][np.diff(offsets) > 0] - 1]
            a, b = np.flatnonzero(starts), np.flatnonzero(stops)
            doc = np.searchsorted(offsets, a, side="right") - 1
            n_spans = np.bincount(doc, minlength=len(per))
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
            kept = data[~gone].tobytes()
            ends = np.cumsum(np.diff(offsets) - removed)
            digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            bounds = pa.StructArray.from_arrays([pa.array((a - offsets[doc]).astype(np.int32)), pa.array((b - offsets[doc]).astype(np.int32))], ["begin", "end"])
            where = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32), bounds)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans), pa.array(digests, pa.string()), where], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    out = f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin: int, end: int>>"
    return _with(rows, flags, "windows", "left").mapInArrow(run, out).withColumnRenamed("key", id_col)
