"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is split by the vocabulary's pattern. The distinct pieces of a slice of rows are laid out as matrices of byte
ids, one matrix for each bucket of lengths, padded with -1. In a round, every row looks up the ranks of its adjacent
pairs in a hash table, merges its leftmost pair of least rank, and moves what follows one place to the left; rows
without a pair that can merge leave the matrix. Pieces repeat a lot, so a worker keeps what it has encoded, up to a
bound, and forgets all of it when the bound is reached.

Defined results: null and empty texts have no ids. Rows are independent, so repeated rows and ties need no rule. A
round moves the rest of its row, so a piece of more than ``WIDE`` bytes (letters without any break) would cost the
square of its length: it is a row of its own, held as a linked list, with its pairs in a heap by rank and place, which
merges in the same order. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import column, ramp, slices

#: Bytes of text taken at once, pieces that a worker remembers, and the longest piece that shares a matrix.
SLICE, REMEMBERED, WIDE = 2 << 20, 400_000, 256
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks by token, and the merges as an open-addressing hash table from a pair of ids to the id of the two joined."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        tokens = sorted(ranks, key=ranks.get)
        ids = np.array([ranks[t] for t in tokens])
        size = np.zeros(ids.max() + 2, dtype=np.int64)
        size[ids + 1] = [len(t) for t in tokens]
        self.token_length, self.token_start, self.token_bytes = size[1:], np.cumsum(size)[:-1], np.frombuffer(b"".join(tokens), np.uint8)
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    left.append(a), right.append(b), joined.append(rank)
        self._fill(np.array(left, np.int64), np.array(right, np.int64), np.array(joined, np.int32))
        self.forget()

    def forget(self) -> None:
        """Start with no pieces remembered: where each piece's ids begin in the pool, and how many there are."""
        self.words: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _fill(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> None:
        keys = left << 32 | right
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(waiting):  # each round, the first that asks for a free slot gets it; the others try the next slot
            self.probes += 1
            at = slot[waiting]
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = waiting[free][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], joined[won]
            waiting = waiting[self.keys[slot[waiting]] != keys[waiting]]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id, which is the rank, of each pair joined; NONE where no such token exists."""
        keys = left.astype(np.int64) << 32 | right
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrix of byte ids (padded with -1) after all merges, and the number of ids in each row."""
        out, out_lengths = rows.copy(), lengths.copy()
        active, ids = np.arange(len(rows)), rows
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(active) and ids.shape[1] > 1:
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(ids)), at]
            on = best != NONE
            if not on.all():
                done = active[~on]
                out[done], out[done, : ids.shape[1]] = -1, ids[~on]
                active, ids, ranks, at, best = active[on], ids[on], ranks[on], at[on], best[on]
                if not len(active):
                    break
            row = np.arange(len(ids))
            moved = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, moved + (moved > at[:, None]), axis=1)
            ids[row, at] = best
            out_lengths[active] -= 1
            pairs = moved[:, :-1]
            ranks = np.take_along_axis(ranks, pairs + (pairs >= at[:, None]), axis=1)
            if ranks.shape[1]:
                before, after = np.maximum(at - 1, 0), np.minimum(at, ranks.shape[1] - 1)
                has_before, has_after = at > 0, at < ranks.shape[1]
                ranks[row[has_before], before[has_before]] = self.rank(ids[row, before], ids[row, at])[has_before]
                ranks[row[has_after], after[has_after]] = self.rank(ids[row, at], ids[row, np.minimum(at + 1, ids.shape[1] - 1)])[has_after]
            width = out_lengths[active].max()
            ids, ranks = ids[:, :width], ranks[:, : max(0, width - 1)]
        if len(active):
            out[active], out[active, : ids.shape[1]] = -1, ids
        return out, out_lengths

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """What ``merge`` makes of one row, in time that grows as its length times the logarithm of that."""
        if not hasattr(self, "joined"):
            used = self.keys >= 0
            self.joined = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        n, symbol, joined = len(ids), ids.tolist(), self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(ids[:-1], ids[1:])
        at = np.flatnonzero(ranks != NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist(), ids[at].tolist(), ids[at + 1].tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            other = after[k]
            if symbol[k] != left or other >= n or symbol[other] != right:
                continue  # one of the two is merged by now
            symbol[k], symbol[other] = rank, -1
            after[k] = following = after[other]
            if following < n:
                before[following] = k
                if (new := joined.get(rank << 32 | symbol[following])) is not None:
                    heapq.heappush(heap, (new, k, rank, symbol[following]))
            if (previous := before[k]) >= 0 and (new := joined.get(symbol[previous] << 32 | rank)) is not None:
                heapq.heappush(heap, (new, previous, symbol[previous], rank))
        return np.array([s for s in symbol if s >= 0], np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that the worker hasn't met."""
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        sorted_lengths = lengths[order]
        pools, sizes, begin = [self.pool], [self.size], 0
        while begin < len(order):
            width = int(sorted_lengths[begin])
            if width > WIDE:
                k = order[begin]
                pools.append(self.merge_long(self.of_byte[data[starts[k] : starts[k] + width]]))
                sizes.append(np.array([len(pools[-1])]))
                begin += 1
                continue
            top = max(4, 1 << (width - 1).bit_length())
            end = int(np.searchsorted(sorted_lengths, top, side="right"))
            end = min(end, begin + max(1, (1 << 19) // top))
            rows, n = order[begin:end], sorted_lengths[begin:end]
            matrix = np.full((len(rows), int(n[-1])), -1, np.int32)
            where = ramp(n)
            matrix[np.repeat(np.arange(len(rows)), n), where] = self.of_byte[data[np.repeat(starts[rows], n) + where]]
            ids, counts = self.merge(matrix, n)
            pools.append(ids[np.arange(ids.shape[1])[None, :] < counts[:, None]])
            sizes.append(counts)
            begin = end
        self.words.update(zip([pieces[k] for k in order.tolist()], range(len(self.words), len(self.words) + len(pieces)), strict=True))
        self.pool, self.size = np.concatenate(pools), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and how many each text has."""
        found = [self.pattern.findall(t) for t in texts]
        distinct = {p for pieces in found for p in pieces}
        if len(self.words) + len(distinct) > REMEMBERED:
            self.forget()
        if new := [p for p in distinct if p not in self.words]:
            self.learn(new)
        words = self.words
        index = np.array(list(map(words.__getitem__, chain.from_iterable(found))), dtype=np.int64)
        per_text = np.array([len(pieces) for pieces in found], dtype=np.int64)
        if not len(index):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        counts = self.size[index]
        ids = self.pool[np.repeat(self.start[index], counts) + ramp(counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(per_text)
        return ids, sums[ends] - sums[ends - per_text]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids end to end, and how many each id has."""
        n = self.token_length[ids]
        return self.token_bytes[np.repeat(self.token_start[ids], n) + ramp(n)], n


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            ids, counts = vocabulary(path, pattern).encode([t or "" for t in column(batch, "text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["key", "ids"])

    rows = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded binary`` of every array of ids. Null: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "ids")
            counts = np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
            data, sizes = vocabulary(path, pattern).decode(np.asarray(lists.flatten(), dtype=np.int64))
            sums = np.concatenate([[0], np.cumsum(sizes)])
            at = sums[np.concatenate([[0], np.cumsum(counts)])]
            raw = data.tobytes()
            parts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(parts, pa.binary())], ["key", "decoded"])

    rows = encoded.select(encoded[id_col].alias("key"), encoded[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, decoded binary").withColumnRenamed("key", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and digest both: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    What ``encode`` then ``decode`` give, without moving the ids out of the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            vocab = vocabulary(path, pattern)
            ids, counts = vocab.encode([t or "" for t in column(batch, "text").to_pylist()])
            data, sizes = vocab.decode(ids)
            at = np.concatenate([[0], np.cumsum(counts)])
            bytes_at = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
            raw_ids, raw, at = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes()), (at * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "key"),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(raw_ids[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bytes_at[:-1], bytes_at[1:], strict=True)]),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    out = f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, out).withColumnRenamed("key", id_col)
