"""The field's marginals against all paths, line features against plain counts, and held-out accuracy."""

from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import catalogue, quality
from tessera.llm.common import utf8

SF = "/root/testdata/sf0.01"


def features_of(texts):
    return quality.lines(*utf8(pa.array(texts, pa.string())))


@pytest.mark.parametrize("seed", range(5))
def test_marginals_are_sums_over_all_paths(seed):
    rng = np.random.default_rng(seed)
    many = [int(rng.integers(1, 8)) for _ in range(4)]
    first = np.concatenate([np.arange(n) == 0 for n in many])
    score, change = rng.normal(0, 2, sum(many)), rng.normal(0, 2, (2, 2))
    good, pairs = quality.marginals(score, change, first)
    at = 0
    for n in many:
        wanted, both = np.zeros(n), np.zeros((n, 2, 2))
        total = 0.0
        for path in product((0, 1), repeat=n):
            weight = np.exp(sum(score[at + k] * s for k, s in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
            total += weight
            wanted += weight * np.array(path)
            for k in range(1, n):
                both[k, path[k - 1], path[k]] += weight
        assert np.allclose(good[at : at + n], wanted / total) and np.allclose(pairs[at : at + n], both / total)
        at += n


def test_long_chains_stay_finite():
    good, _ = quality.marginals(np.full(5000, -30.0), np.array([[5.0, -9.0], [-9.0, 5.0]]), np.arange(5000) == 0)
    assert np.isfinite(good).all() and good.max() < 1e-9


def test_line_features():
    texts = [None, "", "\n\n", "One line.\n\nab ab ab cd$ é1|\nOne line.", "One line.", " \t ", "x" * 300 + " y!"]
    features, text, size = features_of(texts)
    assert text.tolist() == [3, 3, 3, 4, 5, 6] and size.tolist() == [9, 17, 9, 9, 3, 303]
    assert features[:, 16].tolist() == [0, 0, 1, 0, 0, 0]  # only the third stood before in its own text
    assert np.allclose(features[0], features[3]) and features[0, 14] == 1 and features[1, 14] == 0
    assert features[1, 10] == pytest.approx(2 / 5) and features[1, 11] == pytest.approx(2 / 5) and features[1, 12] == pytest.approx(3 / 5)
    shares = features[1, 1:10] ** 2 * 17
    assert np.allclose(shares, [8, 0, 1, 2, 4, 0, 0, 1, 1], atol=1e-4)
    assert features[:, 15].tolist() == [1, 0, 1, 1, 1, 1]


def test_lines_are_the_same_in_chunks(monkeypatch):
    texts = ["Some words here.\nand more, and more\n" * 50, "z", None, "a b\n" * 9]
    whole = features_of(texts)
    monkeypatch.setattr(quality, "SLICE", 8)
    for x, y in zip(whole, features_of(texts), strict=True):
        assert np.array_equal(x, y)


def test_means_are_weighted_by_length():
    assert np.allclose(quality.document_means(np.array([1.0, 0.0, 0.5]), np.array([30, 10, 7]), np.array([0, 0, 2]), 3)[[0, 2]], [0.75, 0.5])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    found = catalogue.QUERIES["op11_line_quality"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    back = got[got.held_out & got.quality.notna()]
    assert len(back) > 50 and (back.predicted == back.quality).mean() > 0.95


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, "text") for k in range(17)] + [(None, 1, "x"), (3, None, "x"), (4, 1, "x"), (7, 7, "x")], "doc_id long, quality int, text string")
    model = quality.fit(odd, labels)
    got = quality.predict(odd, model).join(odd.select("doc_id", "text"), "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    assert (got[got.text.isna() | got.text.isin(["", "\n\n"])].score - model.share).abs().max() < 1e-9
    of = quality.predict(odd, model).toPandas()
    assert len(of) == odd.count() and of[of.doc_id == 8].score.nunique() == 1


def test_without_labels_or_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.predict(odd, quality.fit(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.predict(odd, quality.fit(odd, one)).collect()} == {1}
    assert quality.predict(empty, quality.fit(empty, none)).collect() == []
