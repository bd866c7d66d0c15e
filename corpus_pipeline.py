"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sealcheck.llm.language import keep_identified
from sealcheck.llm.leaks import decontaminate
from sealcheck.llm.lines import dedup_lines
from sealcheck.llm.minhash import keep_one
from sealcheck.llm.mixing import mix
from sealcheck.session import configure, cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in no known language."""
    configure(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that near-duplicate an earlier one, short ones that repeat one, and documents that have no other line."""
    configure(spark)
    return dedup_lines(docs, min_chars=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    configure(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontaminate(docs, configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix."""
    configure(spark)
    return mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix_sources)]

# Classifier, edit join and signatures are not SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result written to the shared folder and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
