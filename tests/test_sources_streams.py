"""Files, pages, spatial joins and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import lookup, resolution, spatial
from tessera.sources import files, pages
from tessera.streaming import events as stream


def test_events_skip_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event": "search", "zip": "20850"}\n{broken\n{"event": "click", "orgId": "a"}\n')
    assert sorted(r["event"] for r in files.read_events(spark, str(tmp_path / "log.jsonl")).collect()) == ["click", "search"]


def test_envelope(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"stats": {}, "total": 2, "records": [{"name": "a"}, {"name": "b"}]}))
    assert [r["name"] for r in files.read_envelope(spark, str(tmp_path / "a.json"), "name: string").collect()] == ["a", "b"]


def test_sources_are_isolated(spark):
    frame, status = files.collect_sources({"good": lambda: spark.createDataFrame([("a",)], "name string"), "bad": lambda: 1 / 0}, ["good", "bad"])
    assert frame.count() == 1 and status["good"] == "ok" and status["bad"].startswith("error")


def test_a_source_that_fails_when_read_gives_no_rows(spark):
    late = F.udf(lambda k: 1 // (k - 7), "long")
    sources = {"good": lambda: spark.range(3), "late": lambda: spark.range(10).select(late("id").alias("id"))}
    frame, status = files.collect_sources(sources, ["good", "late"])
    assert {r["source_id"] for r in frame.collect()} == {"good"} and frame.count() == 3 and status["late"].startswith("error")


def test_page_strategies(spark):
    html = "<nav><li>Menu 301-555-1234 here</li></nav><h2>Food Hub</h2><p>12 Main Street</p><p>301-555-0000 MD 20850</p><table><tr><td>Bank</td><td>301-555-9999</td></tr><tr><td>x</td></tr></table><ul><li>Pantry, 5 Oak Ave, open daily</li><li>short</li></ul>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = pages.page_records(rows).where("strategy IS NOT NULL").orderBy("strategy").collect()
    assert [(r["page_id"], r["strategy"], r["phone"], r["zip"]) for r in got] == [(1, "heading", "301-555-0000", "20850"), (1, "list", None, None), (1, "table", "301-555-9999", None)]


def test_grid_join_is_exact(spark):
    a = spark.range(300).selectExpr("id", "38.5 + (id * 37 % 100) / 400 AS lat", "-77.5 + (id * 91 % 100) / 400 AS lon")
    b = spark.range(200).selectExpr("id AS other", "38.5 + (id * 53 % 100) / 400 AS b_lat", "-77.5 + (id * 29 % 100) / 400 AS b_lon")
    near = spatial.within(a, b, 2500.0, ("lat", "lon"), ("b_lat", "b_lon"))
    exact = a.join(b, spatial.haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")) <= 2500)
    assert sorted(map(tuple, near.select("id", "other").collect())) == sorted(map(tuple, exact.select("id", "other").collect()))


def test_groups_of_chains(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(20, 60)] + [(5, 3), (3, 1), (5, 5)], "a long, b long")
    got = dict(map(tuple, resolution.groups(links).collect()))
    assert {got[k] for k in range(20, 61)} == {20} and got[5] == got[3] == got[1] == 1


def test_cache_states(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2023-01-01 00:00:00")], "k string, at string")
    got = lookup.with_cache(rows, cache, "k", "at", F.lit("2024-01-01 00:30:00"), 3600)
    assert {r["k"]: r["cache_state"] for r in got.collect()} == {"a": "hit", "b": "stale", "c": "miss"}
    assert [r["k"] for r in lookup.todo(rows, cache, "k").collect()] == ["c"]


def in_two_batches(spark, rows, folder):
    """A stream of the rows and, in a later batch, of one row that moves the watermark past all of them."""
    rows.coalesce(1).write.parquet(f"{folder}/in")
    late = rows.limit(1).withColumn("ts", F.expr("timestamp'2030-01-01'")).withColumn("event_id", F.lit(-1).cast(rows.schema["event_id"].dataType))
    late.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def events_of(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(spark, frame, folder, mode="append"):
    query = stream.run_available(frame, f"{folder}/out", f"{folder}/ck", mode)
    assert query.awaitTermination(120)
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("what", ["tumbling", "sessions"])
def test_stream_equals_batch(spark, tmp_path, what):
    rows, over = events_of(spark), getattr(stream, what)
    got = streamed(spark, over(in_two_batches(spark, rows, tmp_path)), tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, over(rows).collect()))


def test_stream_without_repeats(spark, tmp_path):
    rows = events_of(spark)
    got = streamed(spark, stream.without_repeats(in_two_batches(spark, rows.union(rows), tmp_path)), tmp_path)
    assert sorted(r["event_id"] for r in got.collect() if r["event_id"] >= 0) == sorted(r["event_id"] for r in rows.collect())


def test_stream_summary(spark, tmp_path):
    source = in_two_batches(spark, events_of(spark), tmp_path)
    query = stream.summary(source).writeStream.format("memory").queryName("summed").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    whole = spark.read.parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, spark.table("summed").collect())) == sorted(map(tuple, stream.summary(whole).collect()))


def test_stream_cache(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for keys in (["a", "a", "b"], ["a", "c"]):
        spark.createDataFrame([(x,) for x in keys], "k string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("k string").parquet(f"{tmp_path}/in")
        answers = stream.cached(source, "k", lambda x: None if x == "b" else x.upper())
        query = answers.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").start()
        end = time.time() + 60
        while sum(p["numInputRows"] for p in query.recentProgress) < len(keys) and time.time() < end:
            time.sleep(0.2)
        query.stop()
    got = spark.read.schema("k string, value string, hit boolean").parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", "A", False), ("a", "A", False), ("a", "A", True), ("b", None, False), ("c", "C", False)]


def test_more_siblings(spark):
    html = "<h3>Menu</h3><p>x</p><h2>Food Hub</h2>" + "".join(f"<p>line {k}</p>" for k in range(7)) + "<p>301-555-0000</p>"
    rows = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r["name"], r["phone"]) for n in (5, 8) for r in pages.page_records(rows, siblings=n).collect()] == [("Food Hub", None), ("Food Hub", "301-555-0000")]
