"""The corpus pipeline: stages over documents, each calling one operator of tributary.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import contamination, mixing, neardup, quality, sharding
from tributary.llm.common import table
from tributary.session import stage

SHARDS = 40
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.apply_rules(docs).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return neardup.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; n_chars is that of what is left."""
    left = contamination.remove_passages(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return contamination.with_sizes(left).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their shares of tokens.

    Where a share asks for more tokens than there are, its documents come several times.
    """
    return mixing.repeated(mixing.mix_sources(docs), COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.assign_shards(docs.select(*COLUMNS), docs["doc_id"], [1.0] * SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shards),
]

# The stages sample, hash and index in ways that SQL can't state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name)
    return docs
