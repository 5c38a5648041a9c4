"""Nearest neighbours against all pairs, on even ground and where very many points share a spot."""

import math
import random

import pytest

from tessera.operators import spatial

HERE, THERE = ("lat", "lon"), ("s_lat", "s_lon")


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1.0, x)))


def plain(left, right, k, radius):
    out = set()
    for p, *here in left:
        if None not in here:
            near = sorted((metres(here, there), s) for s, *there in right if None not in there)
            out |= {(p, s, n + 1) for n, (d, s) in enumerate([x for x in near if x[0] <= radius][:k])}
    return out


def found(spark, left, right, k, radius, formed=False):
    a, b = spark.createDataFrame(left, "p long, lat double, lon double"), spark.createDataFrame(right, "s long, s_lat double, s_lon double")
    got = {(r["p"], r["s"], r["rank"]) for r in spatial.nearest(a, b, k, radius, "p", "s", HERE, THERE).collect()}
    return got, spatial.nearest_candidates(a, b, k, radius, "s", HERE, THERE).count() if formed else 0


def spread(rng, n, width, lat=38.9, lon=-77.0):
    return [(k, lat + rng.uniform(-width, width), lon + rng.uniform(-width, width)) for k in range(n)]


@pytest.mark.parametrize(("k", "width"), [(1, 0.1), (3, 0.1), (5, 0.01)])
def test_even_ground(spark, k, width):
    rng = random.Random(k)
    left, right = [*spread(rng, 60, width), (900, None, 1.0), (901, 89.0, 0.0)], [*spread(rng, 500, width), (9999, 38.9, None)]
    got, _ = found(spark, left, right, k, 3000.0)
    assert got == plain(left, right, k, 3000.0)


def test_crowded_spot(spark):
    """Most points lie within some metres, 2 km from the places; they are met a few at a time."""
    rng = random.Random(4)
    crowd = [(k, 38.9 + rng.uniform(-1e-4, 1e-4), -77.0 + rng.uniform(-1e-4, 1e-4)) for k in range(6000)]
    left, right = spread(rng, 50, 0.005, 38.918), [*crowd, *[(k + 7000, a, b) for k, a, b in spread(rng, 20, 0.03)]]
    got, formed = found(spark, left, right, 3, 3000.0, formed=True)
    assert got == plain(left, right, 3, 3000.0) and formed < 50 * 6000 / 20


def test_points_of_one_place(spark):
    left, right = [(1, 38.9, -77.0), (2, 38.9, -77.0), (2, 38.901, -77.0)], [(k, 38.9001, -77.0001) for k in range(4000)]
    got, formed = found(spark, left, right, 3, 3000.0, formed=True)
    assert {s for _, s, _ in got} == {0, 1, 2} and formed <= 6 and {(p, n) for p, _, n in got} == {(p, n) for p in (1, 2) for n in (1, 2, 3)}
    assert found(spark, left, [], 3, 3000.0) == (set(), 0) and found(spark, [], right, 3, 3000.0) == (set(), 0)
