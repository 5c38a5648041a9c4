"""Ranked lexical search against a plain version that scores every document, and its SQL."""

import math
from collections import Counter

import duckdb
import pytest

from tessera.llm import catalogue, lexical

SF = "/root/testdata/sf0.001"


def plain(docs, items, k):
    """``item, rank, id, score`` by scoring all documents for all items."""
    words = [(key, [w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in text or "").translate({a: a + 32 for a in range(65, 91)}).split(" ") if w]) for key, text in docs]
    words = [(key, found) for key, found in words if found]
    total, count = sum(len(found) for _, found in words), len(words)
    df = Counter(w for _, found in words for w in set(found))
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(x.decode() for x in lexical.terms(text))
    out = []
    asked.pop(None, None)
    for item, wanted in asked.items():
        scores = []
        for key, found in words:
            tf, m = Counter(found), 100 - 25 + (25 * len(found) * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in wanted if w in df)
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, n + 1, key, -score) for n, (score, _, key) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return out


def held(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


ITEMS = [(1, "quick brown fox"), (2, None), (3, "..."), (4, "Seven SEVEN wizards, of some words"), (5, "nothing_of that zzz"), (6, "日本語のテキスト Ç"), (4, "shared passage"), (None, "line one of the lazy dog")]


@pytest.mark.parametrize("few", [lexical.FEW, 2])
@pytest.mark.parametrize("k", [1, 20])
def test_odd_rows(spark, odd, k, few, monkeypatch):
    monkeypatch.setattr(lexical, "FEW", few)  # joins that are shuffled give the same rows
    items = spark.createDataFrame([(*row, 1.5, "x") for row in ITEMS], "item_id int, text string, score double, term string")
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert held(lexical.search(odd, items, k)) == sorted(plain(docs, ITEMS, k), key=repr)


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical.search(empty, items).collect() == [] and lexical.search(odd, items.limit(0)).collect() == []


def test_query(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = catalogue.QUERIES["op12_lexical_search"](spark, SF)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.dtypes[1:] == [("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert held(found) == sorted(con.sql(catalogue.ORACLE_SQL["op12_lexical_search"]).fetchall(), key=repr)
