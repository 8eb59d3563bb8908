"""The registered queries of this subpackage, each over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerf.llm import blocks, curriculum, decontaminate, neardup, pii, quality, restaurants, toxicity, transcripts, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op3_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return transcripts.parse_transcripts(transcripts.transcripts_of(conversations), transcripts.learn(conversations))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.write_blocks(_table(spark, sf_dir, "documents"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.positions(_table(spark, sf_dir, "documents"), curriculum.TARGETS)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_table(spark, sf_dir, "documents"))


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restaurants.perplexities(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_html_wrappers, op3_transcripts, op4_quality_rules, op5_token_blocks, op6_curriculum_mix, op7_pseudonyms, op8_perplexity, op9_near_duplicates, op10_decontaminate)}
ORACLES: dict[str, str] = {"op6_curriculum_mix": curriculum.sql(curriculum.TARGETS)}
