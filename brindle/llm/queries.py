"""The corpus queries: ``opN_<name>`` applies operator N to its whole table, with the SQL that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import html_extraction, license_scan, minhash, mixing, packing, ppm, quality_rules, substring_dedup, token_counts, transport_stream


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), length=2048, end_id=1)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark, documents(spark, sf_dir), length=50)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), limit=1024)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_texts(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.digest(docs, quality_rules.learn(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(spark, documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digests(transport_stream.store(documents(spark, sf_dir)))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_token_counts, op5_html_extraction, op6_mixing, op7_quality_rules, op8_lm_scoring, op9_license_scan, op10_media_columns)}


OP6_SQL = r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS size,
    coalesce(length(text), 0) AS chars, coalesce(length(text), 0) - coalesce(length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS symbols,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / CASE WHEN chars = 0 THEN 0.05::DOUBLE ELSE greatest(0.05::DOUBLE, 1.0::DOUBLE - symbols::DOUBLE / greatest(chars, 1)::DOUBLE) END AS key FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3 AS cap FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size, CASE WHEN cap::DOUBLE <= level * w THEN cap::DOUBLE
    ELSE (SELECT arg_min(level, cap::DOUBLE / w) FROM levels WHERE NOT cap::DOUBLE <= level * w) * w END AS target FROM levels),
placed AS (
  SELECT k.doc_id, k.size, a.source_size, a.target,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun,
    CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / greatest(a.source_size, 1)) AS BIGINT) ELSE 1 END AS epochs
  FROM keyed k JOIN aimed a ON k.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN source_size > 0 AND begun::DOUBLE + size::DOUBLE / 2.0::DOUBLE <= target - (epochs * source_size)::DOUBLE AND target - (epochs * source_size)::DOUBLE > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL}
