"""The corpus pipeline: five stages over `documents`, each on all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm import decontam, mixing, pii, quality, simhash
from ripplegraph.llm.util import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; what little benchmark text others hold is cut out."""
    return decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind; terms that reveal it go."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: documents with their sanitised texts, sources at their weights, in blocks."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("remove_pii", remove_pii),
    ("mix_sources", mix_sources),
]
#: SimHash components, suffix-automaton matches and PII spans are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, f"pipeline-{name}")
    return docs
