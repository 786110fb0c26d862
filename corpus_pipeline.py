"""Corpus pipeline: toxic documents go, common lines are cut, near-duplicates and benchmark leaks go, the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpage.llm import decontam, lines, neardup, pieces, toxicity
from siftpage.llm.common import table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which nothing is left go; those that came empty stay."""
    had = docs.withColumn("__had", F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    out = lines.drop_lines(had)
    left = F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) > 0
    return out.where(left | ~F.col("__had")).drop("__had").withColumn("n_chars", F.length("text").cast("long"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), batch_chars=2_000_000)  # smaller batches: more shuffle, less memory
    return coded.select("doc_id", "ids", F.size("ids").alias("n_ids"))


STAGES = [("toxicity", remove_toxic), ("line_dedup", remove_lines), ("near_dedup", remove_near_duplicates), ("decontamination", remove_leaks), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
