"""The corpus pipeline: quality rules, near-duplicates, repeated passages, the mix of sources, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import minhash, mixing, packing, quality_rules, substring_dedup
from brindle.llm.common import cut
from brindle.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return quality_rules.filter_stage(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return minhash.keep_one(spark, docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without 50-byte passages that an earlier one has."""
    return substring_dedup.strip_stage(spark, docs, length=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as its source's epochs and the draw say, not at all or up to three times."""
    mixed = mixing.mix(docs, keep_rows=True).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a worker remembers fewer words than it would alone, as it serves the other stages too."""
    return packing.pack_sequences(docs, tokenizer("word_bpe_49k.json"), length=2048, end_id=1, remember=250_000)


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("suffix_array_dedup", passage_dedup), ("mixing", mix_sources), ("packing", pack)]

#: SQL cannot express MinHash groups, suffix arrays or packing; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(spark, docs)
    return docs
