"""The text operators' queries over whole tables, and the SQL that each is held against where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, lexical, lines, lzprint, media, packing, phrases, pii, quality, sharding, simhash, suffix
from tessera.session import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeated(table(spark, sf_dir, "documents")).drop("removed")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_spans")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~quality.held_out()), table(spark, sf_dir, "labels"))
    return quality.predict(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe, "op2_language_id": op2_language_id, "op3_lz_fingerprint": op3_lz_fingerprint, "op4_suffix_dedup": op4_suffix_dedup, "op5_media": op5_media, "op6_pii": op6_pii, "op7_line_dedup": op7_line_dedup, "op8_simhash": op8_simhash, "op9_packing": op9_packing, "op10_sharding": op10_sharding, "op11_line_quality": op11_line_quality, "op12_lexical_search": op12_lexical_search, "op13_collocations": op13_collocations}

#: A-Z and a-z, and the terms of a text in lower case: letters, digits and all that isn't ASCII.
_CASES, _TERM = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'", r"'[0-9a-z\x{80}-\x{10FFFF}]+'"

#: Operator 4 is over hexadecimal text, in which a byte is two characters. Those without SQL depend on digests, models or searches that SQL
#: has no function for; their tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op4_suffix_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents)
, w AS (SELECT r, s, substr(h, CAST(2 * s + 1 AS BIGINT), 400) AS v FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS s FROM d WHERE length(h) >= 400))
, twice AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1)
, hit AS (SELECT r, s FROM w SEMI JOIN twice ON w.v = twice.v)
, isle AS (SELECT r, s, sum(CASE WHEN p IS NULL OR s > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS g FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM hit))
, runs AS (SELECT r, g, min(s) AS a, max(s) + 200 AS b FROM isle GROUP BY r, g)
, cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY r ORDER BY a) IS NULL AS last FROM runs)
, kept AS (SELECT c.r, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)) || CASE WHEN last THEN substr(h, CAST(2 * b + 1 AS BIGINT)) ELSE '' END, '' ORDER BY a) AS k, sum(b - a) AS n_removed, count(*) AS n_spans FROM cut c JOIN d ON c.r = d.r GROUP BY c.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r""",
    "op12_lexical_search": rf"""WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_CASES}), {_TERM})) AS term FROM documents)
, sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id)
, total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes)
, asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {_CASES}), {_TERM})) AS term FROM benchmark) GROUP BY item_id, term)
, held AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term)
, weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total)
, impacts AS (SELECT h.doc_id, h.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS impact FROM held h JOIN weights w ON h.term = w.term JOIN sizes s ON h.doc_id = s.doc_id, total)
, scored AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM asked a JOIN impacts i ON a.term = i.term GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20""",
    "op13_collocations": rf"""WITH pieces AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, {_CASES}), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents))
, lists AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces)
, starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS s FROM lists)
, runs AS (SELECT lang, unnest(range(1, 6)) AS size, ws, s FROM starts)
, found AS (SELECT lang, array_to_string(ws[s:s + size - 1], ' ') AS phrase, any_value(size) AS size, count(*) AS a FROM runs WHERE s + size - 1 <= len(ws) GROUP BY 1, 2)
, total AS (SELECT lang, CAST(sum(a) AS HUGEINT) AS n FROM found WHERE size = 1 GROUP BY lang)
, often AS (SELECT *, string_split(phrase, ' ') AS ws FROM found WHERE a >= 100)
, cuts AS (SELECT lang, phrase, a, ws, size, unnest(range(1, size)) AS k FROM often WHERE size > 1)
, scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS score FROM cuts c JOIN often x ON c.lang = x.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN often y ON c.lang = y.lang AND y.phrase = array_to_string(c.ws[k + 1:c.size], ' ') JOIN total t ON c.lang = t.lang)
, lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1)
, covered AS (SELECT DISTINCT q.lang, array_to_string(q.ws[b:b + m - 1], ' ') AS phrase, q.a FROM (SELECT lang, ws, size, a, unnest(range(1, size + 1)) AS b FROM often) q, range(2, 5) AS sizes(m) WHERE m < q.size AND b + m - 1 <= q.size)
, kept AS (SELECT * FROM lowest l WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = l.lang AND c.phrase = l.phrase AND c.a >= l.a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000""",
}
