"""Most frequent values from summaries against exact counts, for summaries of any length."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tessera.operators import frequent


@pytest.mark.parametrize("keep", [1, 3, 10, 100])
@pytest.mark.parametrize("k", [1, 5, 50])
def test_most_frequent(spark, keep, k):
    rng = random.Random(keep * 100 + k)
    rows = [(n, datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 600)), None if rng.random() < 0.05 else min(30, int(rng.expovariate(0.25)))) for n in range(1500)]
    log = spark.createDataFrame(rows, "n long, ts timestamp, who int")
    told = frequent.summaries(log, "ts", "who", "n", keep).cache()
    counts, first = Counter(w for *_, w in rows if w is not None), {}
    for n, _, w in rows:
        first.setdefault(w, n)
    wanted = sorted(counts.items(), key=lambda x: (-x[1], first[x[0]]))[:k]
    got = frequent.most_frequent(told, log, "ts", "who", "n", k)
    assert [(r["value"], r["n"]) for r in got.collect()] == wanted
    assert told.where("value IS NOT NULL").groupBy("hour").count().agg({"count": "max"}).first()[0] <= keep


def test_summaries_alone_where_they_hold_all(spark):
    log = spark.createDataFrame([(n, datetime(2024, 1, 1, n % 3), n % 4) for n in range(60)], "n long, ts timestamp, who int")
    told = frequent.summaries(log, "ts", "who", "n", 10)
    unread = log.where("raise_error('the log is read') IS NULL")
    assert {(r["value"], r["n"]) for r in frequent.most_frequent(told, unread, "ts", "who", "n", 4).collect()} == {(k, 15) for k in range(4)}
    assert frequent.most_frequent(told.limit(0), log.limit(0), "ts", "who", "n", 4).collect() == []
