"""Collocations against a plain version that counts every n-gram, and against the SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import catalogue, phrases

SF = "/root/testdata/sf0.001"
LOWER = {a: a + 32 for a in range(65, 91)}


def plain(rows, first, least):
    """``lang, rank, phrase, a, l, r, n, score`` by the definition; ``rows`` are of language and text."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang or "und"] += len(words)
            for size in range(1, 6):
                counts.update((lang or "und", *words[k : k + size]) for k in range(len(words) - size + 1))
    often = {p: a for p, a in counts.items() if a >= least}
    kept = {}
    for (lang, *p), a in often.items():
        longer = (q for q, b in often.items() if q[0] == lang and len(q) > len(p) + 1 and b >= a)
        if len(p) > 1 and not any(list(q[k : k + len(p)]) == p for q in longer for k in range(1, len(q) - len(p) + 1)):
            cuts = [(often[lang, *p[:k]], often[lang, *p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min((1000 * a * total[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
            kept.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return [(lang, k + 1, p.decode(), -a, l, r, total[lang], -score) for lang, found in kept.items() for k, (score, a, p, l, r) in enumerate(sorted(found)[:first])]


def held(found):
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("least", [2, 5])
def test_odd_rows(spark, odd, least):
    rows = [(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()]
    assert held(phrases.collocations(odd, 30, least)) == sorted(plain(rows, 30, least))


@pytest.mark.parametrize(("known", "share"), [(phrases.KNOWN, 7), (3, phrases.SHARE), (3, 7), (1, 1)])
def test_parts_and_hashed_words(spark, known, share):
    rng = np.random.default_rng(5)
    words = ["a", "the", "x;y", "Ä", "long,", "\x1f", "Tab\tbed", "the.", "b", "c"]
    rows = [("en" if k % 3 else None, " ".join(rng.choice(words, rng.integers(1, 80), p=[0.3, 0.2, *[0.5 / 8] * 8]))) for k in range(120)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found, totals = phrases.frequent(docs, 4, known=known, share=share)
    counts = {(r["lang"], r["phrase"]): r["a"] for r in found.collect()}
    wanted, total = Counter(), Counter()
    for lang, text in rows:
        for run in phrases.tokens(text):
            for piece in b" ".join(run).decode().split("."):
                of = piece.split(" ")
                of = [w for w in of if w]
                total[lang or "und"] += len(of)
                for size in range(1, 6):
                    wanted.update((lang or "und", " ".join(of[k : k + size])) for k in range(len(of) - size + 1))
    assert counts == {p: a for p, a in wanted.items() if a >= 4}
    assert {r["lang"]: r["n"] for r in totals.collect()} == total


def test_large_counts_are_exact(spark):
    row = spark.createDataFrame([(10**12 + 1, 10**15 + 7, 10**13 + 3, 10**13 + 9)], "a long, n long, l long, r long")
    assert row.select(phrases.score().alias("s")).first()["s"] == 1000 * (10**12 + 1) * (10**15 + 7) // ((10**13 + 3) * (10**13 + 9))


def test_empty_tables(empty):
    assert phrases.collocations(empty).collect() == []


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = catalogue.QUERIES["op13_collocations"](spark, SF)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {k for _, k in found.dtypes} == {"string", "bigint"}
    got = held(found)
    assert got == sorted(con.sql(catalogue.ORACLE_SQL["op13_collocations"]).fetchall()) and got
