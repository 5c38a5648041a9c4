"""SimHash fingerprints, and near-duplicates found with BK-trees over them.

Two documents whose fingerprints differ in at most ``radius`` bits agree on one of ``radius`` + 1 blocks of the bits.
Distinct fingerprints are therefore dealt into buckets by block; a bucket of more than ``CROWD`` is dealt anew by
blocks of the bits that are still free, as often as it takes, so no bucket grows with the data. Each bucket is a shard
with a BK-tree of its own: children are keyed by their Hamming distance to the parent, and a search follows the edges
within the radius. The trees stay in the task that holds the bucket; broadcasting them, as on a small corpus, would
send every executor something as large as the corpus. A bucket tells a spanning forest of its links, never all pairs.

``near_duplicates`` finds documents whose word shingles are alike. Fingerprints of the shingle sets go through the same
trees first, and the sets decide on the links that these tell. Many alike documents differ in more bits than blocks can
be made for; so that none of these links is lost, documents that share one of their rarest shingles meet after that,
unless the trees' links have already joined them, and the sets decide again.

Defined results: null and empty texts have no words and fingerprint 0 (one group in ``near_duplicates``). Repeated rows
share a fingerprint. Null ids are never a group's id unless all ids of the group are null. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, cut, emptied, ramp, released, slices, staged
from tessera.llm.components import components

SLICE, CROWD = 1 << 20, 128


class BKTree:
    """A Burkhard-Keller tree over integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Put ``value`` below the node that it differs from by a distance that has no child yet."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """``distance, number`` of the values added so far that differ in at most ``radius`` bits."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append((distance, node))
            if children := self.children[node]:
                todo += [n for d, n in children.items() if distance - radius <= d <= distance + radius]
        return found


class Groups:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words (A-Z in lower case, split at ASCII white space); fewer: of them all."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), seed) for k in range(len(words) - width + 1)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each document: the bits that are set in more than half of its hashes."""
    out = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(counts) - counts)[some]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(sums * 2 > counts[some, None], axis=1).view(">i8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` (64 bits as a long) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = [shingle_hashes(t, width, seed) for t in column(batch, "text").to_pylist()]
            counts = np.array([len(x) for x in found], np.int64)
            hashes = np.array([h for x in found for h in x], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(majority(hashes, counts))], ["key", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fingerprint long").withColumnRenamed("key", id_col)


def _split(mask: int, parts: int) -> list[int]:
    """The mask together with each of ``parts`` blocks of the bits that it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = np.array_split(np.array(free, dtype=np.int64), parts)
    return [mask | sum(1 << int(b) for b in block) for block in blocks if len(block)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all that differ in at most ``radius`` bits.

    ``distinct`` has one column, ``fingerprint``, without repeats.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for values in column(batch, "values").to_pylist():
                tree, groups = BKTree(), Groups(len(values))
                for k, value in enumerate(values):
                    for _, other in tree.within(value & 0xFFFFFFFFFFFFFFFF, radius):
                        if groups.join(k, other):
                            a.append(values[k]), b.append(values[other])
                    tree.add(value & 0xFFFFFFFFFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    spark, found = distinct.sparkSession, None
    masks = {0: _split(0, radius + 1)}
    rows = distinct.select("fingerprint", F.lit(0).cast("long").alias("mask"))
    while True:
        child = spark.createDataFrame([(_signed(m), [_signed(x) for x in xs]) for m, xs in masks.items()], "mask long, children array<long>")
        rows = rows.join(F.broadcast(child), "mask").select("fingerprint", F.explode("children").alias("mask")).distinct()  # the table has a row for each mask: a fixed number
        rows = cut(rows.withColumn("bits", F.col("fingerprint").bitwiseAND(F.col("mask"))))
        sizes = rows.groupBy("mask", "bits").count()
        next_masks = {x: _split(x, radius + 1) for xs in masks.values() for x in xs if x != (1 << 64) - 1}
        last = all(x.bit_count() >= 50 for xs in masks.values() for x in xs)
        fit = F.lit(True) if last else F.col("count") <= CROWD
        few = rows.join(sizes.where((F.col("count") > 1) & fit).drop("count"), ["mask", "bits"])
        edges = few.groupBy("mask", "bits").agg(F.sort_array(F.collect_set("fingerprint")).alias("values")).select("values").mapInArrow(trees, "a long, b long")
        edges = cut(edges)  # each level by itself: one plan of all levels and what follows is long, and the driver keeps it
        found = edges if found is None else found.union(edges)
        if last:
            return found
        crowds = sizes.where(F.col("count") > CROWD).drop("count")
        if crowds.isEmpty():
            return found
        rows = rows.join(crowds, ["mask", "bits"]).select("fingerprint", "mask").distinct()
        masks = next_masks


def classes(docs: DataFrame, width: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id``: the smallest id that is reachable over links of at most ``radius`` bits."""
    prints = cut(fingerprints(docs, width, seed, id_col, text_col))
    distinct = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    found = components(links(distinct.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    label = distinct.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    label = label.join(least, "component").select("fingerprint", "component_id")
    return prints.join(label, "fingerprint").select(id_col, "fingerprint", "component_id")


# Near-duplicates by shingle similarity ---------------------------------------------------------------------------

#: Documents in one part of a comparison; components up to which size it goes pair by pair.
SHARD, SMALL = 400, 16
#: Slots in which the shingles of about ``SAMPLE`` documents are counted: a table of fixed size. Shingles of
#: slots with more than ``HOT`` of them are met without dealing their documents to one task. The most nodes to broadcast.
SLOTS, SAMPLE, HOT, BROADCAST = 1 << 18, 20_000, 0.01, 1 << 20


def _set(text: str | None, width: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width, seed), np.uint64))


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences, first all low bytes, last all high ones, which compress."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def bitmap(values: np.ndarray) -> bytes:
    """A bit for each of the numbers, at its remainder by the length: a power of two, at least twice as many as there are."""
    size = max(64, 1 << (2 * len(values) - 1).bit_length()) if len(values) else 64
    bits = np.zeros(size, np.uint8)
    bits[(values % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def can_be_alike(a: bytes, n_a: int, b: bytes, n_b: int, similarity: float) -> bool:
    """Whether sets of these bitmaps and sizes can be alike: a bit that only one has stands for a number that only one has."""
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * max(len(a), len(b))
    while size > 8 * min(len(a), len(b)):  # the longer one folded, which is what the shorter length would have given
        size //= 2
        x, y = (z >> size | z & ((1 << size) - 1) for z in (x, y))
    both = min(n_a - (x & ~y).bit_count(), n_b - (y & ~x).bit_count())
    return both >= similarity * (n_a + n_b - both) - 1e-6


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


def _frequencies(docs: DataFrame, n: int, width: int, seed: int) -> np.ndarray:
    """How often shingles of each slot stand in a sample of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in slices(batches, "text", SLICE):
            for t in column(batch, "text").to_pylist():
                np.add.at(counts, _slot(_set(t, width, seed)), 1)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], ["slot", "n"])

    wanted = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * min(1, SAMPLE / max(n, 1)))
    found = docs.where(wanted).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    out = np.zeros(SLOTS, np.uint32)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def prefix(n: int, similarity: float) -> int:
    """Of ``n`` shingles in an order that all sets share, how many must be looked at to meet every set alike."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id``: documents linked, over any number of steps, by shingle sets of at least ``similarity``.

    Ids must be distinct. Documents with equal sets are one node, named by a 64-bit hash of the set. All sets are put
    in one order, rare shingles first. Nodes whose fingerprints (of the distinct shingles) BK-trees link are held
    against each other first (``links``), and so are nodes of one fingerprint. For what trees can't tell, two that are
    alike share one of the first shingles of each (``prefix``), and of the first that they share, so many stand at or
    after it in both sets as they must have in common (``_may_meet``). So the nodes that have a shingle are held next
    against the one in which the fewest rarer shingles stand before it: a text has none of what its edited copies add,
    so that is where they come from. What is found alike is joined to components; a shingle whose nodes are in one
    component is done. What is left is compared in full: for every two components that may meet at a shingle, those of
    the smaller one that have it meet every member of the larger, pair by pair or in parts of about ``SHARD``
    documents. So no pair is lost, and no task holds a whole crowd.

    Shingles are 64-bit hashes throughout. Their first ones are written once, and whole sets never: those of nodes in a
    pair are made again from the text, if bitmaps of the two sets leave it open that they are alike (``can_be_alike``).
    What moves is the first shingles, pairs with bitmaps, and the sets of the few pairs that these leave.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    n_docs = rows.count()
    often = _frequencies(rows, n_docs, width, seed)
    crowd = max(20, HOT * min(n_docs, SAMPLE), 4 * float(often.mean()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = [_set(t, width, seed) for t in column(batch, "text").to_pylist()]
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            size = np.array([len(x) for x in found], np.int32)
            bits, prints = pa.array([bitmap(x) for x in found], pa.binary()), majority(np.concatenate(found), size.astype(np.int64))
            found = [x[np.argsort(often[_slot(x)], kind="stable")[: prefix(len(x), similarity)]] for x in found]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(node), pa.array(size), pa.array(prints), bits, pa.array([x.tobytes() for x in found], pa.binary())], ["key", "node", "n", "fingerprint", "bits", "first"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "first", SLICE):
            found = [np.frombuffer(x, np.uint64) for x in column(batch, "first").to_pylist()]
            many = np.array([len(x) for x in found], np.int64)
            own, token = pa.array(np.repeat(np.arange(len(found)), many)), np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ramp(many).astype(np.int32)), column(batch, "n").take(own), column(batch, "node").take(own), pa.array(often[_slot(token)] >= crowd)], ["token", "pos", "n", "node", "hot"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array([_packed(_set(t, width, seed)) for t in column(batch, "text").to_pylist()], pa.binary())], ["node", "set"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by token, pos and node: those of tokens that several nodes have, once each, with the first node's.

        A token's rows pass by; only the first is kept. Rows that can be alike to none of the token's go.
        """
        head, last, given = None, 0, False  # of the last token so far: its first row, its latest node, and whether it was given
        for batch in batches:
            if not len(batch):
                continue
            goes_on = head is not None and head[0] == column(batch, "token")[0].as_py()
            token, pos, n, node = (np.concatenate([np.array([head[k]] if goes_on else [], np.int64), column(batch, c).to_numpy().astype(np.int64)]) for k, c in enumerate(("token", "pos", "n", "node")))
            new = np.append(True, token[1:] != token[:-1])
            fresh = new | np.append(True, node[1:] != node[:-1])
            if goes_on:
                fresh[1] = new[1] or node[1] != last
            run, first = np.cumsum(new) - 1, np.flatnonzero(new)
            several = np.bincount(run[fresh]) > 1
            several[0] |= goes_on and given
            keep = fresh & several[run]
            keep[0] &= not (goes_on and given)
            keep = np.flatnonzero(keep)
            at = first[run[keep]]
            can = pos[keep] + similarity * pos[at] <= (1 - similarity) * n[keep] + 1e-6  # else no set that has it, at such a place or later, can be alike
            keep, at = keep[can], at[can]
            head, last, given = (token[first[-1]], pos[first[-1]], n[first[-1]], node[first[-1]]), node[-1], bool(several[-1])
            arrays = [pa.array(x.astype(t)) for x, t in zip((token[keep], pos[keep], n[keep], node[keep], pos[at], n[at], node[at]), (np.int64, np.int32, np.int32, np.int64, np.int32, np.int32, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["token", "pos", "n", "node", "head_pos", "head_n", "head"])

    def keep_possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(column(batch, c).to_pylist() for c in ("bits_a", "n_a", "bits_b", "n_b")), strict=True)
            yield batch.filter(pa.array([can_be_alike(*row, similarity) for row in each], pa.bool_())).select(["a", "b"])

    def keep_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([_unpacked(s) for s in column(batch, c).to_pylist()] for c in ("set_a", "set_b"))
            yield batch.filter(pa.array([_alike(p, q, similarity) for p, q in zip(x, y, strict=True)], pa.bool_())).select(["a", "b"])

    def one_of(nodes: DataFrame, until: list[tuple[str, DataFrame]]) -> DataFrame:
        """``node, key, n, bits`` of one document for each of the distinct nodes given."""
        nodes = staged(nodes, until)
        small = nodes.count() <= BROADCAST
        one = every.select("node", F.struct("key", "n", "bits").alias("one")).join(F.broadcast(nodes) if small else nodes, "node", "left_semi").groupBy("node").agg(F.min("one").alias("one"))
        return staged(one.select("node", "one.*"), until)

    def sets_of(one: DataFrame) -> DataFrame:
        """``node, set``, made again from the text of the documents ``node, key``; the others' texts stay where they are if these are few enough to tell."""
        small = one.count() <= BROADCAST
        return rows.join(F.broadcast(one) if small else one, "key").select("node", "text").mapInArrow(again, "node long, set binary")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs ``a, b``, in which many may have one ``b``, those that are alike."""
        until: list[tuple[str, DataFrame]] = []
        pairs = staged(pairs.distinct(), until)
        one = one_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), until)
        asking, asked = (one.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
        pairs = staged(pairs.join(asking, "a").join(asked, "b").mapInArrow(keep_possible, "a long, b long"), until)
        released(docs.sparkSession)
        asking, asked = (sets_of(staged(one.join(pairs.select(F.col(x).alias("node")), "node", "left_semi").select("node", "key"), until)).withColumnsRenamed({"node": x, "set": f"set_{x}"}) for x in "ab")
        pairs = pairs.join(asking, "a").join(asked, "b")
        alike = cut(pairs.select("a", "b", "set_a", "set_b").mapInArrow(keep_alike, "a long, b long"))
        emptied(until)
        return alike

    def meet(group: pa.Table) -> pa.Table:
        """A link of every one that asks to one of the members in this part, if any is alike."""
        asks = np.array(group.column("asks").to_pylist(), bool)
        own = [_unpacked(x) for x in group.column("set").to_pylist()]
        members, a, b = np.flatnonzero(~asks), [], []
        sizes = np.array([len(own[k]) for k in members], np.int64)
        if len(members):
            tokens, owner = np.concatenate([own[k] for k in members]), np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for k in np.flatnonzero(asks).tolist():
                begin = np.searchsorted(tokens, own[k])
                many = np.searchsorted(tokens, own[k], "right") - begin
                both = np.bincount(owner[np.repeat(begin, many) + ramp(many)], minlength=len(members))
                if len(hit := np.flatnonzero(both >= similarity * (len(own[k]) + sizes - both))):
                    a.append(k), b.append(members[hit[0]])
        nodes = group.column("node")
        return pa.table({"a": nodes.take(pa.array(a, pa.int64())), "b": nodes.take(pa.array(b, pa.int64()))})

    early: list[tuple[str, DataFrame]] = []
    middle: list[tuple[str, DataFrame]] = []
    late: list[tuple[str, DataFrame]] = []
    every = staged(rows.mapInArrow(sets, f"key {kind}, node long, n int, fingerprint long, bits binary, first binary"), late)
    label = components(verified(_by_trees(every)))
    released(docs.sparkSession)
    keys = every.select("node", "n", "first").mapInArrow(prefixes, "token long, pos int, n int, node long, hot boolean")
    hot = staged(keys.where("hot").drop("hot").distinct(), early)
    heads = hot.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("one"), F.count("*").alias("nodes")).where("nodes > 1")
    heads = staged(heads.select("token", F.col("one.pos").alias("head_pos"), F.col("one.n").alias("head_n"), F.col("one.node").alias("head")))
    hot = hot.join(heads, "token").where(F.col("pos") + similarity * F.col("head_pos") <= (1 - similarity) * F.col("n") + 1e-6).select("token", "pos", "n", "node", "head_pos", "head_n", "head")  # adaptive execution splits it at crowded shingles
    cold = keys.where("NOT hot").drop("hot").repartition("token").sortWithinPartitions("token", "pos", "node")
    keyed = staged(hot.unionByName(cold.mapInArrow(met, "token long, pos int, n int, node long, head_pos int, head_n int, head long")), middle)
    emptied(early)
    least = similarity / (1 + similarity)
    near = keyed.where("node != head").where(_may_meet(F.col("pos"), F.col("n"), F.col("head_pos"), F.col("head_n"), least))
    near = near.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    of_a, of_b = (label.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    near = near.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    label = components(_stars(label).union(verified(near)))
    released(docs.sparkSession)
    now = staged(keyed.select("token", "pos", "n", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), late)
    emptied(middle)
    several = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    left = staged(now.join(several, "token"), late)
    released(docs.sparkSession)
    if not left.isEmpty():
        found = _rest(left, label, lambda nodes: sets_of(one_of(nodes, late).select("node", "key")), least, verified, meet)
        label = components(reduce(DataFrame.union, found, _stars(label)))
    of = every.select("key", "node").join(label, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    named = of.groupBy("component").agg(F.min("key").alias("component_id"))
    result = staged(of.join(staged(named), "component").select(F.col("key").alias(id_col), "component_id"))
    emptied(late)
    return result


def _stars(label: DataFrame) -> DataFrame:
    """What is joined already, as a link ``a, b`` of every node to its component: fewer rounds than all links again."""
    return label.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _by_trees(every: DataFrame) -> DataFrame:
    """Pairs of nodes ``a, b`` that the trees link by their fingerprints: one node stands for all of a fingerprint, and is linked to them."""
    nodes = staged(every.select("node", "fingerprint").distinct())
    prints = staged(nodes.groupBy("fingerprint").agg(F.min("node").alias("one")))
    same = nodes.join(prints, "fingerprint").where("node != one").select(F.col("node").alias("a"), F.col("one").alias("b"))
    ends = [prints.select(F.col("fingerprint").alias(x), F.col("one").alias(f"one_{x}")) for x in "ab"]
    near = links(prints.select("fingerprint")).join(ends[0], "a").join(ends[1], "b")
    return near.select(F.col("one_a").alias("a"), F.col("one_b").alias("b")).union(same)


def _may_meet(pos: Column, n: Column, other_pos: Column, other_n: Column, least: float) -> Column:
    """Whether two sets whose first shared shingle stands at these places can have ``least`` of their sizes in common."""
    return F.least(n - pos, other_n - other_pos) >= F.lit(least) * (n + other_n) - F.lit(1e-6)


def _rest(left: DataFrame, label: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float, verified: Callable[[DataFrame], DataFrame], meet: Callable[[pa.Table], pa.Table]) -> list[DataFrame]:
    """The links ``a, b`` between components that share a token, as far as it takes to join them."""
    members = label.select("component", F.col("node").alias("member"))
    n_of = members.groupBy("component").agg(F.count("*").alias("many"))
    known = staged(left.join(n_of, "component", "left").select("token", "pos", "n", "node", F.struct(F.coalesce("many", F.lit(1)).alias("many"), "component").alias("own")))
    rest = F.col("n") - F.col("pos")
    others = known.groupBy("token", F.col("own").alias("larger")).agg(F.min("n").alias("n_low"), F.max(rest - F.lit(least) * F.col("n")).alias("room"))
    can = (F.col("room") >= F.lit(least) * F.col("n") - F.lit(1e-6)) & (rest >= F.lit(least) * (F.col("n") + F.col("n_low")) - F.lit(1e-6))
    pairs = known.alias("k").join(others.alias("o"), (F.col("k.token") == F.col("o.token")) & (F.col("own") < F.col("larger")) & can)
    items = cut(pairs.select("node", F.col("larger.component").alias("component"), F.col("larger.many").alias("many")).distinct())
    single = items.where("many = 1").select(F.col("node").alias("a"), F.col("component").alias("b"))
    few = items.where(F.col("many").between(2, SMALL)).join(members, "component").select(F.col("node").alias("a"), F.col("member").alias("b"))
    out = [verified(single.union(few))]
    many = items.where(F.col("many") > SMALL)
    parts = cut(many.groupBy("component", "many").agg(F.count("*").alias("asked")).select("component", F.ceil(F.col("many") / SHARD).alias("parts"), F.ceil(F.col("asked") / SHARD).alias("chunks")))
    if parts.isEmpty():
        return out

    def deal(rows: DataFrame, own: str, over: str, own_name: str, over_name: str) -> DataFrame:
        """Each row in a part of its own kind, and in all of the other kind."""
        part = F.pmod(F.xxhash64("node"), F.col(own)).alias(own_name)
        return rows.join(parts, "component").select("component", "node", "asks", part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(over) - 1)).alias(over_name))

    asking = deal(many.select("component", "node", F.lit(True).alias("asks")), "chunks", "parts", "chunk", "part")
    asked = deal(members.select("component", F.col("member").alias("node"), F.lit(False).alias("asks")), "parts", "chunks", "part", "chunk")
    dealt = staged(asking.unionByName(asked))
    dealt = dealt.join(sets_of(dealt.select("node").distinct()), "node").select("component", "part", "chunk", "node", "asks", "set")
    return [*out, cut(dealt.groupBy("component", "part", "chunk").applyInArrow(meet, "a long, b long"))]


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each group of near-duplicates: the one of least id.

    Rows with null or repeated ids are told apart by a number of their own, and then that number decides.
    """
    unclear = docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1))
    if unclear.isEmpty():
        kept = near_duplicates(docs, width, similarity, seed, id_col, text_col).where(F.col(id_col) == F.col("component_id"))
        return docs.join(kept.select(id_col), id_col, "left_semi").select(*docs.columns)
    row = f"row_{uuid.uuid4().hex}"  # no input has a column of that name
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = near_duplicates(rows, width, similarity, seed, row, text_col).where(F.col(row) == F.col("component_id")).select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
