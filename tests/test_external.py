"""Calls to services: their pace, their pauses by cause, and our own answers."""

import pytest

from tessera.sources import external


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


@pytest.mark.parametrize(("per_second", "tasks"), [(2.0, 1), (2.0, 4), (0.5, 3)])
def test_all_tasks_together_keep_the_rate(per_second, tasks):
    made = []
    for _ in range(tasks):
        clock = Clock()
        pace = external.Pace(per_second, tasks, clock, clock.sleep)
        for _ in range(10):
            pace.wait()
            made.append(clock.now)
            clock.now += 0.01
    made.sort()
    assert max(sum(t <= x < t + 10 for x in made) for t in made) <= 10 * per_second + tasks


def test_slow_calls_need_no_pause():
    clock = Clock()
    pace = external.Pace(1.0, 1, clock, clock.sleep)
    for _ in range(3):
        pace.wait()
        clock.now += 5
    assert clock.slept == []


def test_pauses_by_cause():
    failures, slept = [external.failure_of(c) for c in (503, 429, 503)], []

    def call(row):
        if failures:
            raise failures.pop(0)
        return {"v": 1}

    patience = external.Patience(4, {external.Throttled: 30.0, external.Unavailable: 5.0, external.Retry: 2.0})
    assert external.with_retries(call, patience, sleep=slept.append)({}) == ({"v": 1}, "ok") and slept == [5.0, 30.0, 10.0]


@pytest.mark.parametrize(("failure", "status"), [(external.Retry(), "retries"), (TimeoutError(), "timeout"), (external.failure_of(404), "ValueError")])
def test_own_answers(failure, status):
    def call(row):
        raise failure

    slept = []
    own = lambda row: {"v": row["k"]}
    assert external.with_retries(call, own=own, sleep=slept.append)({"k": 7}) == ({"v": 7}, f"own:{status}")
    assert external.with_retries(call, sleep=slept.append)({"k": 7})[0] is None


def test_calls_are_counted_once_a_row(spark, tmp_path):
    def call(row):
        with open(tmp_path / f"{row['k']}", "a") as f:
            f.write("x")
        if row["k"] % 3 == 0:
            raise external.Throttled
        return {"v": row["k"] * 2}

    rows = spark.range(12).selectExpr("CAST(id AS INT) AS k")
    got = external.enrich(rows, call, "v long", external.Patience(2, {external.Retry: 0.0}), per_second=1000.0, tasks=3).toPandas()
    assert sorted(got.k) == list(range(12)) and {k: len((tmp_path / f"{k}").read_text()) for k in range(12)} == {k: 2 if k % 3 == 0 else 1 for k in range(12)}
    assert (got[got.k % 3 == 0].status == "error:retries").all() and (got[got.k % 3 > 0].v == got[got.k % 3 > 0].k * 2).all()


def test_directions_by_rules():
    row = {"metro": "X", "metro_lines": "RD", "metro_minutes": 5, "bus": None, "bus_minutes": None}
    assert external.directions(row) == {"directions": "Take the RD line to X, then walk 5 minutes.", "recommended": "metro"}
    assert external.directions({**row, "bus": "70", "bus_minutes": 4})["recommended"] == "bus"
    assert external.directions(dict.fromkeys(row, None)) == {"directions": None, "recommended": None}
