"""The as-of join against a plain search, with ties, hot keys and nulls."""

import random
from datetime import datetime, timedelta

from tessera.operators import asof

BEGIN = datetime(2024, 1, 1)


def test_as_of_against_a_plain_search(spark):
    rng = random.Random(2)
    when = lambda: BEGIN + timedelta(hours=rng.randint(0, 24 * 200))
    keys = ["hot"] * 8 + ["a", "b", "c"]
    versions = [(rng.choice(keys), when(), k) for k in range(300)]
    versions += [(k, t, v + 1000) for k, t, v in versions[:20]] + [(None, when(), -1), ("a", None, -2)]
    requests = [(n, rng.choice([*keys, "d"]), when()) for n in range(400)] + [(400, "hot", versions[0][1]), (401, None, when()), (402, "hot", None), (403, "hot", BEGIN - timedelta(days=900)), (404, "hot", BEGIN + timedelta(days=900))]
    a = spark.createDataFrame(requests, "n long, stop string, at timestamp").repartition(3)
    b = spark.createDataFrame(versions, "stop string, since timestamp, v long").repartition(3)

    def plain(key, at):
        known = [(t, v) for k, t, v in versions if k == key and None not in (k, t, at) and t <= at]
        return max(known, default=(None, None))

    wanted = {n: plain(key, at) for n, key, at in requests}
    for bucket in (86400, 30 * 86400, 10**9):
        got = {r["n"]: (r["since"], r["v"]) for r in asof.as_of(a, b, "stop", "at", "since", ["v"], bucket).collect()}
        assert got == wanted
    assert asof.as_of(a, b.limit(0), "stop", "at", "since", ["v"]).where("v IS NOT NULL").count() == 0


def test_each_of_the_answers_wins(spark):
    day = lambda k: BEGIN + timedelta(days=k)
    requests = spark.createDataFrame([(k, f"s{k}", day(100)) for k in range(5)], "n long, stop string, at timestamp")
    cache = spark.createDataFrame([("s0", day(99), 38.0, -77.0), ("s1", day(10), 38.0, -77.0), ("s2", day(99), 10.0, -77.0)], "stop string, since timestamp, lat double, lon double")
    service = spark.createDataFrame([("s0", day(1), 38.1, -77.0), ("s1", day(50), 38.1, -77.0), ("s1", day(101), 38.9, -77.0), ("s2", day(1), 0.0, 0.0)], "stop string, since timestamp, lat double, lon double")
    static = spark.createDataFrame([(f"s{k}", 38.2, -77.0) for k in (0, 1, 2, 3, 3)], "stop string, lat double, lon double")
    got = {r["stop"]: (r["answered_by"], r["lat"]) for r in asof.stops_as_of(requests, cache, service, static, "at", 7).collect()}
    assert got == {"s0": ("cache", 38.0), "s1": ("service", 38.1), "s2": ("static", 38.2), "s3": ("static", 38.2), "s4": ("none", None)}
