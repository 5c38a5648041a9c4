"""A corpus from documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, lines, packing, pii, simhash
from tessera.llm.common import released, staged
from tessera.session import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others (no letters, or no language near enough) go."""
    found = langid.predict(docs, langid.fit(docs), keep=docs.columns)
    return found.where("NOT rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every unit of text stays where it stands first and goes elsewhere."""
    return lines.remove_repeats(docs).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data."""
    return pii.replace_pii(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, a row for each piece."""
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    return packing.pack(docs, *paths, public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("private", private), ("pack", pack)]

#: Language, near-duplicates and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        released(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
