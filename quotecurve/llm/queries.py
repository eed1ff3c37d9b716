"""Registered queries of the training-data operators, over the whole given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotecurve.llm import alignment, bpe, conversations, ctw, hnsw, mixing, quality, sharding, simhash, suffix, toxicity, twins, vptree, warc
from quotecurve.llm.common import load


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(load(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.assess(load(spark, folder, "documents"))
    return judged.drop("content", "host", "removed_lines").withColumnRenamed("id", "doc_id")


def op4_context_tree_weighting(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.score(load(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(load(spark, folder, "documents"), load(spark, folder, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(load(spark, folder, "documents")).drop("ids").withColumnRenamed("id", "doc_id")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(load(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.near_duplicates(load(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(load(spark, folder, "pages"))
    return warc.read_archives(archives).drop("url", "payload")


def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.removed_passages(load(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(load(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op12_approximate_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.nearest(load(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_conversation_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damaged_and_repaired(load(spark, folder, "conversations")).withColumnRenamed("conv", "conv_id")


_OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, source FROM documents),
w AS (SELECT r, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM d),
placed AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT r, i, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3
  FROM placed WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM win WHERE w3 IS NOT NULL),
covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY r),
held AS (
  SELECT r, l FROM (SELECT r, unnest(string_split(body, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM held GROUP BY r),
fig AS (
  SELECT d.r, d.doc_id, d.source, d.body, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r)),
base AS (
  SELECT *, n_words < {quality.MIN_WORDS}
    OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM fig),
lines AS (
  SELECT base.r, source, body, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM held JOIN base USING (r) WHERE NOT base_failed),
hosts AS (SELECT source, count(DISTINCT body) AS n FROM base WHERE NOT base_failed GROUP BY source),
often AS (SELECT source, line, count(DISTINCT body) AS n FROM lines GROUP BY source, line),
over_limit AS (
  SELECT often.source, line FROM often JOIN hosts ON often.source IS NOT DISTINCT FROM hosts.source
  WHERE often.n > {quality.LINE_DOCS} AND often.n > hosts.n * CAST({quality.LINE_SHARE} AS DOUBLE)),
removed AS (
  SELECT r, sum(len(string_split(lines.line, ' '))) AS n FROM lines
  JOIN over_limit o ON o.line = lines.line AND o.source IS NOT DISTINCT FROM lines.source GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words,
  NOT base_failed AND n_words - coalesce(removed.n, 0) >= n_words * CAST({quality.MIN_LEFT} AS DOUBLE) AS kept
FROM base LEFT JOIN removed USING (r)
"""

_OP10 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
first AS (SELECT digest, min(page_id) AS page FROM p WHERE n >= {warc.MIN_BYTES} GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN page_id <> first.page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first.page THEN first.page END AS refers_to
FROM p LEFT JOIN first USING (digest)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_context_tree_weighting": op4_context_tree_weighting,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_warc": op10_warc,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_approximate_nearest_neighbours": op12_approximate_nearest_neighbours,
    "op13_conversation_structure_repair": op13_conversation_structure_repair,
}
ORACLES = {
    "op3_quality_rules": _OP3,
    "op7_sharding": twins.OP7,
    "op8_embedding_near_dedup": twins.OP8,
    "op9_suffix_array_dedup": twins.OP9,
    "op10_warc": _OP10,
    "op12_approximate_nearest_neighbours": twins.OP12,
    "op13_conversation_structure_repair": twins.OP13,
}
