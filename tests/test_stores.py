"""Fetching with statuses, the cache's versions, and ingest that is interrupted."""

import ssl
import time

import pytest

from tessera.operators import lookup
from tessera.sources import fetching
from tessera.sources.versions import Conflict, Versions
from tessera.streaming import ingest

SCHEMA = "key string, v int"


def slow(request, seconds):
    time.sleep(3)
    return "late"


def fails(request, seconds):
    raise ssl.SSLError("bad certificate")


def test_clients_and_limit():
    limited = fetching.Limited(0.2)
    good = lambda request, seconds: request["url"].upper()
    assert fetching.fetch({"url": "http://A.b/c"}, {"x": fails, "y": good}, limited) == ("HTTP://A.B/C", "y", "ok")
    assert fetching.fetch({"url": "http://a.b"}, {"x": good, "y": slow}, limited)[2] == "ok"
    assert fetching.fetch({"url": "http://a.b"}, {"y": slow}, limited) == (None, None, "timeout")
    assert fetching.fetch({"url": "http://a.b"}, {"y": slow, "x": good}, limited)[1:] == ("x", "ok")  # the thread left behind blocks nothing
    assert fetching.fetch({"url": "http://a.b"}, {"x": fails}, limited)[2] == "ssl_error"
    assert [fetching.fetch({"url": u}, {"x": good}, limited)[2] for u in (None, "", "no address")] == ["error:no address"] * 3


@pytest.mark.parametrize(("failure", "status"), [(TimeoutError(), "timeout"), (OSError("read timed out"), "timeout"), (OSError("SSL handshake"), "ssl_error"), (ValueError("x"), "error:ValueError")])
def test_statuses(failure, status):
    assert fetching.status_of(failure) == status


def test_hosts_stay_together(spark, tmp_path):
    rows = [(f"https://h{k % 9}.org/{k}" if k % 20 else None,) for k in range(500)]
    spark.createDataFrame(rows, "url string").repartition(3).write.parquet(str(tmp_path / "urls"))
    reader = fetching.FetchReader({"requests": str(tmp_path / "urls"), "partitions": "4", "clients": "tests.test_stores:fails"})
    parts = [[r["url"] for r in reader._own(p)] for p in reader.partitions()]
    assert sorted(map(str, sum(parts, []))) == sorted(str(u) for u, in rows)
    hosts = [{fetching.host_of(u) for u in p} for p in parts]
    assert sum(map(len, hosts)) == len(set().union(*hosts))
    spark.dataSource.register(fetching.FetchedPages)
    got = spark.read.format("fetched_pages").options(requests=str(tmp_path / "urls"), clients="tests.test_stores:fails", partitions=2).load()
    assert {(r["status"], r["count"]) for r in got.groupBy("status").count().collect()} == {("ssl_error", 475), ("error:no address", 25)}


def held(df):
    return {r["key"]: r["v"] for r in df.collect()}


def rows_of(spark, found):
    return spark.createDataFrame(list(found), SCHEMA)


def test_upserts_and_versions(spark, tmp_path):
    cache = Versions(spark, str(tmp_path / "c"), SCHEMA)
    assert cache.number() == 0 and held(cache.read()) == {}
    assert cache.upsert(rows_of(spark, [("a", 1), ("b", 1), ("b", 4), (None, 9)]), "v") == 1
    assert cache.upsert(rows_of(spark, [("b", 2), ("c", 2)])) == 2
    assert held(cache.read()) == {"a": 1, "b": 2, "c": 2} and held(cache.read(1)) == {"a": 1, "b": 4}
    for k in range(10):
        cache.upsert(rows_of(spark, [("d", k)]))
    assert held(cache.read()) == {"a": 1, "b": 2, "c": 2, "d": 9} and len(cache.folders()) < 9
    assert cache.cleared() > 0 and held(cache.read()) == {"a": 1, "b": 2, "c": 2, "d": 9}


def test_a_writer_that_ends_before_its_manifest_shows_nothing(spark, tmp_path, monkeypatch):
    cache = Versions(spark, str(tmp_path / "c"), SCHEMA)
    cache.upsert(rows_of(spark, [("a", 1)]))
    with monkeypatch.context() as m:
        m.setattr(Versions, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            cache.upsert(rows_of(spark, [("a", 2)]))
    again = Versions(spark, str(tmp_path / "c"), SCHEMA)
    assert held(again.read()) == {"a": 1} and again.upsert(rows_of(spark, [("b", 3)])) == 2
    assert held(again.read()) == {"a": 1, "b": 3} and again.cleared() == 1


def test_two_writers(spark, tmp_path):
    one, two = (Versions(spark, str(tmp_path / "c"), SCHEMA) for _ in range(2))
    one.upsert(rows_of(spark, [("a", 1)]))
    with pytest.raises(Conflict):
        two._commit(1, ["data-x"])
    taken = two.number
    two.number = lambda: (setattr(two, "number", taken), 0)[1]  # it looked before the other wrote
    two.upsert(rows_of(spark, [("b", 2)]))
    assert held(one.read()) == {"a": 1, "b": 2} and one.number() == 2


def test_a_run_that_goes_on_asks_for_the_rest(spark, tmp_path):
    cache, asked = Versions(spark, str(tmp_path / "c"), SCHEMA), []

    def fetch(keys):
        asked.append(sorted(r["key"] for r in keys.collect()))
        return keys.selectExpr("key", "length(key) AS v")

    rows = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "key string")
    first = lookup.answered(rows.where("key = 'a'"), cache, "key", fetch).collect()
    second = lookup.answered(rows, cache, "key", fetch).collect()
    assert asked == [["a"], ["bb"]] and {r["cache_state"] for r in first} == {"miss"}
    assert sorted((r["key"] or "", r["v"], r["cache_state"]) for r in second) == [("", None, "miss"), ("a", 1, "hit"), ("a", 1, "hit"), ("bb", 2, "miss")]


LINES = ['{"event": "search", "zip": "20850", "ts": "2024-01-01T00:00:00Z"}', '{"event": "cl', "", "[1]", '{"event": "click"}', "null"]


def test_ingest_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(LINES))
    write, lost = ingest.write_audit, []

    def once(session, path, batch, counts):
        if batch == 1 and not lost:
            lost.append(batch)
            raise RuntimeError("lost")
        write(session, path, batch, counts)

    monkeypatch.setattr(ingest, "write_audit", once)
    with pytest.raises(Exception, match="lost"):
        ingest.ingest(spark, source, out, checkpoint, 1).awaitTermination()
    assert ingest.events(spark, out).count() == 2 and lost  # the second batch's lines are there, and not yet seen
    ingest.ingest(spark, source, out, checkpoint, 1).awaitTermination()
    assert ingest.events(spark, out).count() == 6 and ingest.rejects(spark, out).count() == 9
    assert {r["value"] for r in ingest.rejects(spark, out).collect()} == {'{"event": "cl', "[1]", "null"}
    told = {r["batch"]: (r["n_lines"], r["n_events"], r["n_rejected"], r["at"] is not None) for r in ingest.audit(spark, out).collect()}
    assert told == {k: (5, 2, 3, True) for k in range(3)}
    ingest.ingest(spark, source, out, checkpoint, 1).awaitTermination()
    assert ingest.events(spark, out).count() == 6
