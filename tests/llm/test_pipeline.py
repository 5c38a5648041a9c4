"""The pipeline's stages, one after another, on the smallest tables and on odd rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessera.llm import simhash
from tessera.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    rows, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        found = staged(stage(spark, rows, SF))
        if name != "pack":
            assert found.columns == docs.columns
            assert {r["doc_id"] for r in found.select("doc_id").collect()} <= {r["doc_id"] for r in rows.select("doc_id").collect()}
        rows = found
        sizes.append(rows.select("doc_id").distinct().count())
    assert sizes[0] >= 0.998 * docs.count()  # languages that were learned stay, but for two of a thousand texts at most
    assert sizes[1] < sizes[0] and sizes[1] == sizes[2] == sizes[3] == sizes[4]


@pytest.mark.parametrize("kind", ["odd", "empty", "unlabelled"])
def test_stages_on_other_tables(spark, odd, empty, kind):
    """Odd rows, no rows, and rows of no known language go through all stages; what has no letters goes at the first."""
    rows = {"odd": odd, "empty": empty, "unlabelled": odd.withColumn("lang", F.lit(None).cast("string"))}[kind]
    texts = [{r["text"] for r in rows.select("text").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        found = staged(stage(spark, rows, SF))
        if name != "pack":
            assert found.columns == odd.columns
            texts.append({r["text"] for r in found.select("text").collect()})
        rows = found
    assert texts[1] <= texts[0] and texts[2] <= texts[1] and not texts[1] & {None, "", " ", "\n\n", "1234 5678 !!"}
    assert rows.count() if kind != "empty" else not rows.count()


def test_duplicates_against_all_pairs(spark, docs):
    """The documents that stay after near-duplicates are those of least id in groups linked by 0.8 of their shingles."""
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5, 42)) for r in docs.select("doc_id", "text").collect()}
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert kept == {k for k in sets if top(k) == k}


def test_run_ends_in_sequences(spark):
    got = corpus_pipeline.run(spark, SF).groupBy("sequence_id").agg({"length": "sum"}).toPandas()
    assert got["sum(length)"].max() <= 2048
