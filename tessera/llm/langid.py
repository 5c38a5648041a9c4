"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's features are its words and the runs of 2 to 4 bytes within them, hashed into ``BUCKETS``. Each bucket has an
embedding; the mean of a text's embeddings goes through a linear layer and a softmax. Embeddings and layer are trained
together by stochastic gradient descent in numpy, on a sample of labelled texts of at most ``sample`` rows, each
language having the same share. Of the sample, whole texts are held back to fit a temperature (so that scores are
probabilities) and two bounds of rejection. The score must be at least the one that keeps ``KEEP`` of the held-back
texts, lowered to ``FLOOR`` at most. And the text must be as familiar as they are: the mean logarithm of how often its
subwords stand in the learned texts of the language that it is taken for may be below that of the held-back texts by
chance only, which is more where a text has few subwords. Letters at random, and languages that nothing was learned
of, fail that, however sure the softmax is.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and rejected. Every other text gets a
learned language and the calibrated probability; ``rejected`` tells if that can't be trusted. Rows stand alone, so
repeated rows agree; very long texts are read whole, texts too short for a subword get the languages' shares. Rows
without a language are not learned from; without any labelled text there is nothing to reject by: every prediction is
``und``, and only texts without letters are rejected. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, ramp, slices, utf8

BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 15, 16, 2, 4
EPOCHS, BATCH, STEP = 4, 32, 0.5
#: Bytes of a text that are learned from at once: longer texts are learned as several, predictions take texts whole.
LESSON = 600
#: Deviations that a text's familiarity may be below the least of the held-back texts, and below their mean for chance.
MARGIN, CHANCE = 8.0, 14.0
KEEP, FLOOR = 0.9995, 0.5
SLICE = 1 << 20
LETTER = regex.compile(r"\p{L}")


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each text, and the text of each. Runs that reach over a space or a text's end don't count."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = data.astype(np.uint32)
    lower[(data >= 65) & (data <= 90)] += 32
    space = (data < 65) | (data > 122) & (data < 128) | (data > 90) & (data < 97)
    lower[space] = 32
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found, of = [], []
    run = lower.copy()
    inside = ~space  # a run has at most one space, at an end of it
    ok = np.ones(len(data), bool)
    for n in range(2, LONGEST + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        run = run[:m] * np.uint32(0x01000193) ^ lower[n - 1 :]
        ok = (ok[:m] & (inside[n - 2 : n - 2 + m] if n > 2 else True)) & (text[:m] == text[n - 1 :])
        if n < SHORTEST:
            continue
        at = np.flatnonzero(ok)
        mixed = (run[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        found.append((mixed >> np.uint32(17)).astype(np.int32))
        of.append(text[at].astype(np.int32))
    if not found:  # one byte
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Model:
    """The logits that a bucket adds, which are its embedding times the layer; the temperature; the least score to trust.

    ``familiar`` has the logarithm of each bucket's share in each language, ``usual`` for each language the mean,
    deviation and least of that over its held-back texts, and the deviation of single subwords.
    """

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    familiar: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    usual: np.ndarray | None = None

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, a row for each text; how familiar the text is as the likeliest language; its subwords."""
        n, k = len(offsets) - 1, len(self.languages)
        bucket, text = _features(data, offsets)
        count = np.bincount(text, minlength=n)
        sums = np.stack([np.bincount(text, weights=self.logits[bucket, j], minlength=n) for j in range(k)], axis=1)
        odds = softmax((sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        near = np.bincount(text, weights=self.familiar[bucket, odds.argmax(axis=1)[text]], minlength=n) / np.maximum(count, 1)
        return odds, near, count

    def strange(self, best: np.ndarray, near: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether texts are less familiar than the language's held-back ones by more than chance."""
        if self.usual is None:
            return np.zeros(len(best), bool)
        mean, spread, lowest, single = self.usual[best].T
        return (count > 0) & (near < np.minimum(lowest - MARGIN * spread, mean - CHANCE * single / np.sqrt(np.maximum(count, 1))))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 2) -> Model:
    """Fit a model to labelled texts."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    parts, target, whole = [], [], []
    for text, label in zip(texts, labels, strict=True):
        raw = text.encode()
        back = rng.random() < 0.2  # whole texts are held back, not parts
        if back and languages.index(label) in target:
            whole.append((label, raw))
            continue
        for k in range(0, max(1, len(raw)), LESSON):
            parts.append(raw[k : k + LESSON]), target.append(languages.index(label))
    buckets, counts = [], []
    for k in range(0, len(parts), 200):  # a few at a time: the features take many times the room of the text
        some = parts[k : k + 200]
        bucket, text = _features(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in some])]).astype(np.int64))
        buckets.append(bucket[np.argsort(text, kind="stable")].astype(np.uint16))
        counts.append(np.bincount(text, minlength=len(some)))
    bucket, counts = np.concatenate(buckets), np.concatenate(counts)
    del buckets
    starts = np.cumsum(counts) - counts
    target = np.array(target)
    k = len(languages)
    embedding, layer, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, k)), np.zeros(k)
    weight = 1 / np.maximum(1, np.bincount(target, minlength=k))
    weight *= len(target) / k
    learn = np.flatnonzero(counts > 0)
    for epoch in range(EPOCHS):
        step = STEP * (1 - epoch / EPOCHS)
        rng.shuffle(learn)
        for begin in range(0, len(learn), BATCH):
            rows = learn[begin : begin + BATCH]
            n = counts[rows]
            ids, row = bucket[np.repeat(starts[rows], n) + ramp(n)], np.repeat(np.arange(len(rows)), n)
            firsts = np.cumsum(n) - n
            mean = np.add.reduceat(embedding[ids], firsts, axis=0) / n[:, None]
            gradient = softmax(mean @ layer + bias)
            gradient[np.arange(len(rows)), target[rows]] -= 1
            gradient *= weight[target[rows], None] / len(rows)
            back = gradient @ layer.T / n[:, None]
            layer -= step * mean.T @ gradient
            bias -= step * gradient.sum(axis=0)
            used, where = np.unique(ids, return_inverse=True)
            for j in range(WIDTH):
                embedding[used, j] -= step * BATCH * np.bincount(where, weights=back[row, j], minlength=len(used))
    share = np.stack([np.bincount(bucket[np.repeat(target == j, counts)], minlength=BUCKETS) for j in range(k)], axis=1) + 0.5
    model = Model(languages, embedding @ layer, bias, np.log(share / share.sum(axis=0)).astype(np.float32))
    if whole:
        of = np.array([languages.index(label) for label, _ in whole])
        found = []
        for begin in range(0, len(whole), 50):
            some = [raw for _, raw in whole[begin : begin + 50]]
            found.append(model.scores(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(raw) for raw in some])]).astype(np.int64)))
        odds, near, count = (np.concatenate(x) for x in zip(*found, strict=True))
        logits, some = np.log(odds + 1e-300), count > 0
        heat = np.geomspace(0.02, 20, 70)
        loss = [-np.mean(np.log(softmax(logits / t)[np.arange(len(of)), of][some] + 1e-12)) for t in heat] if some.any() else [0.0]
        model.temperature = float(heat[int(np.argmin(loss))]) if some.any() else 1.0
        best = softmax(logits / model.temperature).max(axis=1)
        model.least = float(min(FLOOR, np.quantile(best, 1 - KEEP)))
        model.usual = np.array([_usual(near[chosen], count[chosen]) for chosen in ((of == j) & (odds.argmax(axis=1) == j) & some for j in range(k))])
    return model


def _usual(near: np.ndarray, count: np.ndarray) -> tuple[float, float, float, float]:
    """Mean, deviation and least familiarity of texts, and the deviation of a single subword; of too few, nothing is strange."""
    if len(near) < 5:
        return (0.0, 0.0, -np.inf, 0.0)
    mean = float(np.average(near, weights=count))
    single = float(np.sqrt(np.mean((near - mean) ** 2 * count)))
    long = near[count >= np.median(count)]
    return mean, float(long.std()), float(long.min()), single


def fit(docs: DataFrame, sample: int = 1600, passages: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Train on at most ``sample`` labelled rows, spread evenly over the languages and picked by a hash of their ids.

    Of a longer text, ``passages`` of ``LESSON`` characters are learned from, at even distances from its begin to its
    end. Only these come to the driver; ``sample`` times ``passages`` times ``LESSON`` characters is the bound, whatever
    the size of the table and of its texts.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(sample).collect()
    if not counts:
        return None
    share = max(1, sample // len(counts))
    of = {r["label"]: r["count"] for r in counts}
    pick = F.xxhash64("id", "label").cast("double") / 2.0**64 + 0.5
    rate = F.create_map(*[x for label, n in of.items() for x in (F.lit(label), F.lit(1.3 * share / n + 30 / n))])[F.col("label")]
    picked = rows.where(pick < rate).orderBy(F.xxhash64("id", "label"), "id", F.xxhash64("text")).limit(2 * sample + 40 * len(of))
    room = passages * LESSON
    begins = [F.floor((F.length("text") - LESSON) * k / max(1, passages - 1)).cast("int") + 1 for k in range(passages)]
    some = F.concat_ws(" ", *[F.substr("text", begin, F.lit(LESSON)) for begin in begins])
    picked = picked.select("label", F.when(F.length("text") <= room, F.col("text")).otherwise(some).alias("text")).collect()
    taken: dict[str, int] = {}
    kept = []
    for r in picked:
        if taken.get(r["label"], 0) < share:
            taken[r["label"]] = taken.get(r["label"], 0) + 1
            kept.append(r)
    return train([r["text"] for r in kept], [r["label"] for r in kept])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``lang_pred, score, rejected`` of every text, after ``id_col`` or after the columns ``keep``."""
    keep = keep or [id_col]
    names = [f"kept{k}" for k in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the size of the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", SLICE):
            texts = column(batch, "text").to_pylist()
            letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts])
            best, score, reject = np.full(len(texts), "und", object), np.zeros(len(texts)), ~letters
            if model is not None:
                odds, near, count = model.scores(*utf8(column(batch, "text")))
                best[letters] = np.array(model.languages, object)[odds.argmax(axis=1)][letters]
                score[letters] = odds.max(axis=1)[letters]
                reject |= (score < model.least) | model.strange(odds.argmax(axis=1), near, count)
            yield pa.RecordBatch.from_arrays([*[column(batch, n) for n in names], pa.array(best, pa.string()), pa.array(score), pa.array(reject)], [*names, "lang_pred", "score", "rejected"])

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    found = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
    return found.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
