"""The similarity join by segments against all pairs, and links against the components of all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import resolution as op

NAMES = "food pantry of the saint mary church community center hope kitchen north east 12 st. grace".split()


def likeness(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 200 * op.common_subsequence(a, b) / (len(a) + len(b))


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=14), st.lists(st.tuples(st.integers(0, 13), st.sampled_from(["", "a", "b", "d"])), max_size=4), st.sampled_from([75.0, 80.0, 92.0]))
def test_alike_strings_meet_at_a_segment(text, changes, least):
    other = text
    for at, letter in changes:
        other = other[:at] + letter + other[at + (letter == "") :]
    short, long = sorted((text, other), key=len)
    if long and short and 200 * op.common_subsequence(short, long) / (len(short) + len(long)) >= least:
        assert set(op.segment_keys(short, least)[0]) & set(op.segment_keys(long, least)[1])


def varied(rng, n):
    """Words, and copies with some letters changed."""
    out = [" ".join(rng.choices(NAMES, k=rng.randint(1, 5))) for _ in range(n)]
    for k in range(0, n, 3):
        x = list(out[k])
        for _ in range(rng.randint(1, 3)):
            x[rng.randrange(len(x))] = rng.choice(["", "x", "ee", "s"])
        out.append("".join(x).strip() or "x")
    return out


@pytest.mark.parametrize(("least", "below"), [(92.0, None), (80.0, 92.0)])
def test_words_of_a_block_against_all_pairs(spark, least, below):
    rng = random.Random(3)
    words = sorted({" ".join(sorted(w.split())) for w in varied(rng, 300)})
    rows = [(str(k % 2), w) for k in range(2) for w in words[:: k + 1]]
    found = op.alike_words(spark.createDataFrame(rows, "zip string, word string"), ["zip"], least, below)
    wanted = set()
    for z in "01":
        own = [w for x, w in rows if x == z]
        wanted |= {(z, a, b) for k, a in enumerate(own) for b in own[k + 1 :] if least <= likeness(a, b) < (below or 101)}
    assert {tuple(r) for r in found.collect()} == {(z, min(a, b), max(a, b)) for z, a, b in wanted} and wanted


def reached(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("fuzzy", [False, True])
def test_links_connect_what_pairs_connect(spark, fuzzy):
    rng = random.Random(8)
    names = varied(rng, 40) + [None, "", " ", "...", "Pantry of the Food", "food pantry of the"]
    rows = [(k, rng.choice(["20850", "20001", "", None]), rng.choice(names), rng.choice(["1 Elm", "2 Elm", None, "Elm"]), rng.choice(["cafb", "mdfb", None]), rng.choice([None, "", "Mon 9-5"])) for k in range(400)]
    records = spark.createDataFrame(rows, "ord long, zip string, name string, address string, source string, hours string")
    pairs = {(r["a"], r["b"]) for r in op.pairs(records, fuzzy=fuzzy).collect()}
    links = [(r["a"], r["b"]) for r in op.links(records, fuzzy=fuzzy).collect()]
    assert reached(links) == reached(pairs) and pairs
    blank = {k for k, _, name, *_ in rows if not (name or "").strip(" .")}
    assert not blank & {x for p in pairs for x in p}
    if not fuzzy:
        assert len(links) < len(rows)


def test_equal_names_give_a_link_each(spark):
    records = spark.range(3000).selectExpr("id AS ord", "'20850' AS zip", "'Hope' AS name", "'1 Elm' AS address", "IF(id % 2 = 0, 'cafb', 'mdfb') AS source", "IF(id % 3 = 0, 'Mon', NULL) AS hours")
    assert op.links(records).count() == 2999


def test_names_are_cleaned_once(spark):
    """What the links are joined from holds clean names; to clean them again in each join costs more than the joins."""
    records = spark.createDataFrame([(1, "20001", "A Hall, Inc.", "1 Elm St", "x", None), (2, "20001", "a hall", "1 Elm St", "y", "Mon")], "ord long, zip string, name string, address string, source string, hours string")
    for found in (op.links(records), op.pairs(records), op.pairs(records, fuzzy=False)):
        assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["a"], r["b"]) for r in found.select("a", "b").collect()} == {(1, 2)}
