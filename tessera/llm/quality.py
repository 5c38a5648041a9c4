"""Quality of documents by a linear-chain conditional random field over their lines.

Each line has a state, good or bad. What speaks for it are the line's own features (length, shares of kinds of bytes,
words that end in symbols, that repeat the word before, that are distinct, lines that stood before), those of the line
before and of the line after, and the state of the line before. Marginals come from forward and backward products of the
2 x 2 matrices of the lines, built for all documents of a batch at once by doubling. A document's quality is the mean of
its lines' marginals, weighted by their lengths in bytes, and a calibration fitted to documents held back makes it a
probability.

Only documents are labelled. At first all lines have the label of their document; in later rounds the lines of bad
documents that the model of the round before is sure of are learned as good ones, though the worst line stays bad.
Learning is spread: the sampled rows' features stay in a table of ``PARTS`` parts, each task goes on from the shared
weights over its part, and the driver gets the weights of each part alone, whose mean the next round begins with.

Defined results: null and empty texts, and those of line ends only, have no lines; their score is the share of good
documents among those learned. Without learned documents of both labels every score is that share too (a half if there
are none). Documents with several labels are learned with each, those with a null label or id not at all. Rows stand
alone, so equal texts have equal scores; long texts are read whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, ramp, slices, staged, utf8

SLICE, PARTS = 1 << 20, 8
#: Rounds, passes of each, documents at a time, and the step; rounds that take labels as they are, and what is surely good.
ROUNDS, EPOCHS, BATCH, STEP, PLAIN, SURE = 5, 6, 16, 0.5, 2, 0.9
#: Kinds of bytes: 0 others, 1 and 2 letters, 3 digits, 4 not ASCII, 5 blanks, 6 marks in sentences, 7 shouts, 8 bars, 9 symbols.
KIND = np.array([1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c > 127 else 5 if c in b" \t" else 6 if c in b".,;:'\"()-" else 7 if c in b"!?" else 8 if c == 124 else 9 if c > 32 else 0 for c in range(256)], np.uint8)
OWN = 17
WIDTH = 3 * OWN + 3


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Begins and ends of all lines that aren't empty, some megabytes of text at a time."""
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    some = ends > starts
    starts, ends = starts[some], ends[some]
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + 4 * SLICE, "right")))
        yield starts[begin:end], ends[begin:end]
        begin = end


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of each text, the text of the line, and its bytes."""
    features, hashes, begins, sizes = [np.zeros((0, OWN), np.float32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for starts, ends in _chunks(data, offsets):
        size = ends - starts
        raw = data[np.repeat(starts, size) + ramp(size)]
        found, mixed = _features(raw, size)
        features.append(found), hashes.append(mixed), begins.append(starts), sizes.append(size)
    features, hashes, begins, sizes = (np.concatenate(x) for x in (features, hashes, begins, sizes))
    text = np.searchsorted(offsets, begins, "right") - 1
    if len(text):
        order = np.lexsort((np.arange(len(text)), hashes, text))
        again = (np.diff(hashes[order]) == 0) & (np.diff(text[order]) == 0)
        features[order[1:][again], OWN - 1] = 1
    return features, text, sizes


def _features(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of lines that stand end to end, but for whether they stood before, and their hashes."""
    n = len(size)
    line, kind = np.repeat(np.arange(n), size), KIND[raw]
    shares = np.bincount(line * 10 + kind, minlength=10 * n).reshape(n, 10)[:, 1:] / size[:, None]
    solid = kind != 5
    new = np.append(True, line[1:] != line[:-1])
    first = np.flatnonzero(solid & (new | np.append(True, ~solid[:-1])))
    last = np.flatnonzero(solid & np.append(new[1:] | ~solid[1:], True))
    out = np.zeros((n, OWN), np.float32)
    out[:, 0] = np.log1p(size) / 5
    out[:, 1:10] = np.sqrt(shares)
    own = line[first]
    words = np.maximum(np.bincount(own, minlength=n), 1)
    out[:, 10] = np.bincount(own, weights=kind[last] >= 7, minlength=n) / words
    powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    at = np.arange(len(raw))
    begun = np.zeros(len(raw), np.int64)
    begun[first] = first
    within = (at - np.maximum.accumulate(begun)) % 64
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[within])])
    word = summed[last + 1] - summed[first]
    same = np.append(False, (word[1:] == word[:-1]) & (own[1:] == own[:-1]))[: len(word)]
    out[:, 11] = np.bincount(own, weights=same, minlength=n) / words
    order = np.lexsort((word, own))
    fresh = np.append(True, (np.diff(word[order]) != 0) | (np.diff(own[order]) != 0))[: len(word)]
    out[:, 12] = np.bincount(own[order][fresh], minlength=n) / words
    out[:, 13] = np.minimum(size / words / 10, 5)
    ends = np.cumsum(size)
    out[:, 14] = (kind[ends - size] == 2) & (kind[ends - 1] == 6)
    out[:, 15] = words < 3
    return out, np.bincount(own, weights=None, minlength=n).astype(np.uint64) + (summed[ends] - summed[ends - size])


def inputs(features: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What speaks for each line's state, with the lines around it, and whether it is a text's first line."""
    n = len(text)
    first = np.append(True, text[1:] != text[:-1])[:n]
    last = np.append(first[1:], True)[:n]
    x = np.zeros((n, WIDTH), np.float32)
    x[:, :OWN] = features
    if n > 1:
        x[1:, OWN : 2 * OWN] = features[:-1] * ~first[1:, None]
        x[:-1, 2 * OWN : 3 * OWN] = features[1:] * ~last[:-1, None]
    x[:, -3], x[:, -2], x[:, -1] = 1, first, last
    return x, first


def marginals(score: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the probability of being good, and of each pair of states with the line before (zero for first lines).

    ``score`` is what speaks for good, ``change`` a 2 x 2 table for the states of the line before and of the line.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    step = np.where(first[:, None, None], 0.0, change[None]) + score[:, None, None] * np.array([0.0, 1.0])
    step = np.exp(step - step.max(axis=(1, 2), keepdims=True))
    starts = np.flatnonzero(first)
    many = np.diff(np.append(starts, n))
    before = ramp(many)
    after = np.repeat(many, many) - 1 - before
    forth, back, d = step.copy(), step.copy(), 1
    while d < many.max():
        for product, room, shift in ((forth, before, -d), (back, after, d)):
            at = np.flatnonzero(room >= d)
            pair = (product[at + shift], product[at]) if shift < 0 else (product[at], product[at + shift])
            new = np.matmul(*pair)
            product[at] = new / new.max(axis=(1, 2), keepdims=True)
        d *= 2
    alpha, beta = forth[:, 0], np.ones((n, 2))
    beta[:-1] = np.where(first[1:, None], 1.0, back[1:].sum(axis=2))
    good = alpha * beta
    good /= good.sum(axis=1, keepdims=True)
    pairs = np.zeros((n, 2, 2))
    pairs[1:] = np.where(first[1:, None, None], 0.0, alpha[:-1, :, None] * step[1:] * beta[1:, None, :])
    pairs /= np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)
    return good[:, 1], pairs


def document_means(good: np.ndarray, size: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Each text's mean over its lines, weighted by their sizes; not a number where there are none."""
    total = np.bincount(text, weights=size, minlength=n)
    with np.errstate(invalid="ignore"):
        return np.bincount(text, weights=size * good, minlength=n) / total


@dataclass
class Model:
    """Weights of a line's features, of the states of neighbouring lines, and the calibration; ``share`` of good ones."""

    weights: np.ndarray
    change: np.ndarray
    share: float
    slope: float = 1.0
    shift: float = 0.0

    def qualities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, text, size = lines(data, offsets)
        x, first = inputs(features, text)
        return document_means(marginals(x @ self.weights, self.change, first)[0], size, text, len(offsets) - 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A probability for each text."""
        found = calibrated(self.qualities(data, offsets), self.slope, self.shift)
        return np.where(np.isnan(found), self.share, found)


def calibrated(quality: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-(slope * _odds(quality) + shift)))


def _odds(quality: np.ndarray) -> np.ndarray:
    quality = np.clip(quality, 1e-4, 1 - 1e-4)
    return np.log(quality / (1 - quality))


def _calibration(quality: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the held-back documents, by Newton's method, held near (1, 0)."""
    x, at = np.stack([_odds(quality), np.ones(len(quality))], axis=1), np.array([1.0, 0.0])
    hold = np.array([0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ at))
        slope = x.T @ (label - p) - hold * (at - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        at = at + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(max(at[0], 0.05)), float(at[1])


def _targets(label: np.ndarray, good: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A state for each line: good ones in good documents, in bad ones what the model says, but for the worst line."""
    if not len(text):
        return np.zeros(0)
    worst = np.minimum.reduceat(good, np.flatnonzero(first))[np.cumsum(first) - 1]
    return np.where(label[text] == 1, 1.0, (good > SURE) & (good > worst))


def _lesson(weights: np.ndarray, change: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights after passes over documents, each as its lines' features and states."""
    rng, weights, change = np.random.default_rng(11), weights.copy(), change.copy()
    held_w, held_c = np.full(weights.shape, 1e-2), np.full(change.shape, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            some = [texts[k] for k in order[begin : begin + BATCH]]
            text = np.repeat(np.arange(len(some)), [len(y) for _, y in some])
            x, first = inputs(np.concatenate([f for f, _ in some]), text)
            y = np.concatenate([y for _, y in some])
            good, pairs = marginals(x @ weights, change, first)
            slope_w = x.T @ (y - good) / len(y)
            seen = np.zeros((2, 2))
            at = np.flatnonzero(~first)
            np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
            slope_c = (seen - pairs.sum(axis=0)) / len(y)
            held_w, held_c = held_w + slope_w**2, held_c + slope_c**2
            weights, change = weights + STEP * slope_w / np.sqrt(held_w), change + STEP * slope_c / np.sqrt(held_c)
    return weights, change


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on at most ``sample`` labelled documents, half of them of each label as far as there are, told by a hash of ids.

    The documents are featurised whole where they are read. To the driver come weights, and for calibration the label
    and the quality of the fifth of the sample that is held back.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.join(rows.select("id"), "id", "left_semi")
    many = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    share = many.get(1, 0) / sum(many.values()) if many else 0.5
    if len(many) < 2:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), share, 0.0, float(_odds(np.array(share))))
    place = F.xxhash64("id", "label")
    picked = [marked.where(F.col("label") == k).orderBy(place, "id").limit(sample // 2) for k in (0, 1)]
    picked = staged(picked[0].union(picked[1]))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            features, text, size = lines(*utf8(column(batch, "text")))
            cuts = np.searchsorted(text, np.arange(len(batch) + 1))
            blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (features, size)]
            yield pa.RecordBatch.from_arrays([column(batch, "label"), column(batch, "back"), column(batch, "place"), *blobs], ["label", "back", "place", "features", "sizes"])

    found = rows.join(F.broadcast(picked), "id").select("label", (F.pmod(place, F.lit(5)) == 0).alias("back"), place.alias("place"), "text")
    found = found.mapInArrow(featurise, "label int, back boolean, place long, features binary, sizes binary").where(F.length("features") > 0)
    found = staged(found.repartition(PARTS, "place").sortWithinPartitions("place", "features"))
    model = Model(np.zeros(WIDTH), np.zeros((2, 2)), share)
    learned = found.where("NOT back").repartition(PARTS, "place").sortWithinPartitions("place", "features")

    def texts_of(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray]]:
        labels, features = [], []
        for batch in batches:
            labels += column(batch, "label").to_pylist()
            features += [np.frombuffer(b, np.float32).reshape(-1, OWN) for b in column(batch, "features").to_pylist()]
        return np.array(labels), features

    for turn in range(ROUNDS):
        weights, change = model.weights, model.change

        def learn(batches: Iterator[pa.RecordBatch], weights=weights, change=change, turn=turn) -> Iterator[pa.RecordBatch]:
            label, features = texts_of(batches)
            if not len(label):
                return
            text = np.repeat(np.arange(len(label)), [len(f) for f in features])
            x, first = inputs(np.concatenate(features), text)
            good = marginals(x @ weights, change, first)[0] if turn >= PLAIN else np.zeros(len(text))
            states = np.split(_targets(label, good, text, first), np.flatnonzero(first)[1:])
            new, changed = _lesson(weights, change, list(zip(features, states, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([len(label)], pa.int64()), pa.array([[*new.tolist(), *changed.ravel().tolist()]], pa.list_(pa.float64()))], ["n", "weights"])

        told = learned.mapInArrow(learn, "n long, weights array<double>").collect()  # a row for each of PARTS
        mean = np.average([r["weights"] for r in told], axis=0, weights=[r["n"] for r in told])
        model.weights, model.change = mean[:WIDTH], mean[WIDTH:].reshape(2, 2)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [np.frombuffer(b, np.float32).reshape(-1, OWN) for b in column(batch, "features").to_pylist()]
            size = np.concatenate([np.frombuffer(b, np.int64) for b in column(batch, "sizes").to_pylist()] or [np.zeros(0, np.int64)])
            text = np.repeat(np.arange(len(features)), [len(f) for f in features])
            x, first = inputs(np.concatenate([np.zeros((0, OWN), np.float32), *features]), text)
            quality = document_means(marginals(x @ model.weights, model.change, first)[0], size, text, len(features))
            yield pa.RecordBatch.from_arrays([column(batch, "label"), pa.array(quality)], ["label", "quality"])

    back = found.where("back").mapInArrow(hold, "label int, quality double").collect()  # a fifth of the sample
    if back:
        label = np.array([r["label"] for r in back], float)
        model.slope, model.shift = _calibration(np.array([r["quality"] for r in back]), label)
        balance = many[1] / many[0] * max(1, (label == 0).sum()) / max(1, (label == 1).sum())
        model.shift += float(np.log(balance))  # the sample has as many of each, the table hasn't
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", good: float = 0.3) -> DataFrame:
    """``id_col, score, predicted``: the probability of a document being good, and 1 if it is at least ``good``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            score = shared.value.scores(*utf8(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(score), pa.array((score >= good).astype(np.int32))], ["key", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double, predicted int")
    return found.withColumnRenamed("key", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
