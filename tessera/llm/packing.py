"""Packing of token sequences into windows by multiway differencing.

A document is cut where a window is full, so that whole windows stand alone; what is left of it, and a last cut into
``grain`` tokens, gives the pieces that are packed. Pieces are dealt over tasks; a task takes them in runs of about
``RUN`` and splits each run into the least number of windows by Karmarkar-Karp differencing: a partial partition is a
vector of window sums; the two with the widest spread are merged, the largest sums of one with the smallest of the
other, until one is left. If a window is over capacity, the run is split anew into one more window.

Defined results: a null or empty text has the end id alone. Repeated rows are packed each for itself. Very long texts
are many whole windows and one rest. Rows with null ids are dealt by their ids' checksums. An empty table gives no rows. Other columns are not read. Only pieces' numbers are
shuffled, never ids or texts.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, slices

#: Pieces that are differenced together, pieces that a task holds at once, and bytes of text tokenised at once.
RUN, HELD, SLICE = 768, 1 << 17, 4 << 20


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window, 0 to ``windows`` - 1, of each size, by Karmarkar-Karp multiway differencing."""
    if windows == 1:
        return np.zeros(len(sizes), np.int64)
    heap, tree = [], []
    for k, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        tree.append(None)
        heap.append((-size, k, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]  # sums are in ascending order: the largest meet the smallest
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        tree.append((a, b, order))
        heapq.heappush(heap, (-int(sums[-1]), len(tree) - 1, sums))
    out = np.zeros(len(sizes), np.int64)
    todo = [(heap[0][1], np.arange(windows))]
    while todo:
        node, labels = todo.pop()  # labels: the window of each place in the node's order
        if tree[node] is None:
            out[node] = labels[-1]
            continue
        a, b, order = tree[node]
        of = np.empty(windows, np.int64)
        of[order] = labels
        todo += [(a, of), (b, of[::-1])]
    return out


def pack_run(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for the sizes such that none is over capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes.tolist(), windows)
        if np.bincount(found, weights=sizes, minlength=windows).max() <= capacity:
            return found
        windows += 1


@lru_cache(maxsize=1)
def encoders(path: str, ranks_path: str, pattern: str):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    exact = Tokenizer.from_file(path)
    added = [t.content for t in exact.get_added_tokens_decoder().values()]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), exact, added


def token_ids(text: str, path: str, ranks_path: str, pattern: str) -> np.ndarray:
    """The ids that the tokenizer in ``path`` gives, without special tokens around them.

    The ranks in ``ranks_path`` are the same vocabulary and give the same ids in a fraction of the time; a text that
    holds a special token's string goes through the tokenizer itself.
    """
    fast, exact, added = encoders(path, ranks_path, pattern)
    if any(a in text for a in added):
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast.encode_ordinary(text), dtype="<u4")


def pack(
    docs: DataFrame, path: str, ranks_path: str, pattern: str, capacity: int = 2048, grain: int = 512, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row for each piece."""
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            row, start, length, crc, tokens = [], [], [], [], []
            for k, text in enumerate(column(batch, "text").to_pylist()):
                ids = np.append(token_ids(text or "", path, ranks_path, pattern), np.uint32(end_id)).astype("<u4")
                whole = len(ids) - len(ids) % capacity
                for a in [*range(0, whole, capacity), *range(whole, len(ids), grain)]:
                    b = min(len(ids), a + (capacity if a < whole else grain))
                    row.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes())), tokens.append(len(ids))
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
            yield pa.RecordBatch.from_arrays([column(batch, "key").take(pa.array(row, pa.int64())), *numbers], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = [], 0
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= HELD:
                found, used = assign(pa.Table.from_batches(held), used)
                yield from found
                held = []
        if sum(map(len, held)):
            yield from assign(pa.Table.from_batches(held), used)[0]

    def assign(found: pa.Table, used: int) -> tuple[list[pa.RecordBatch], int]:
        """The pieces with sequences, of which the task has given ``used`` before."""
        base = found.column("part")[0].as_py() << 32  # a task's sequences have numbers of their own
        length = found.column("length").to_numpy()
        whole, rest = np.flatnonzero(length == capacity), np.flatnonzero(length < capacity)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        sequence[whole] = used + np.arange(len(whole))
        used += len(whole)
        for part in np.array_split(rest, max(1, round(len(rest) / RUN))):
            if not len(part):
                continue
            window = pack_run(length[part], capacity)
            order = np.argsort(window, kind="stable")
            sizes, of = length[part][order], window[order]
            ends = np.cumsum(sizes)
            first = np.searchsorted(of, of)
            sequence[part[order]] = used + of
            offset[part[order]] = ends - sizes - (ends - sizes)[first]
            used += int(window.max()) + 1
        found = found.drop_columns(["part"]).append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))
        return found.to_batches(max_chunksize=10_000), used

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(tokenise, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    dealt = pieces.repartition("key", "start", "ids_crc32").sortWithinPartitions("key", "start", "length", "ids_crc32")
    packed = dealt.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(
        windows, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return packed.withColumnRenamed("key", id_col)
