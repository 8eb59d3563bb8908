"""The corpus pipeline: every stage works on all that its predecessor kept.

Quality rules, near-duplicates, benchmark decontamination, mixing and token output, each with the operator's
production parameters.  Stages but the last return the columns of their input; cases that operators define (nulls,
empty texts, repeated rows, extra columns, empty tables) are theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerf.llm import blocks, curriculum, decontaminate, neardup, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what no rule of a list learned from ``labels`` rejects."""
    return quality.keep(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has no passage of ``benchmark``."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings all documents into training order by the target weights of their sources; what these leave over comes last."""
    return curriculum.mix(docs, curriculum.TARGETS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of range-coded ids, in training order within each."""
    return blocks.write_blocks(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]
#: The first two stages learn rules and search fingerprints, which SQL can't express; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
