"""A training corpus from ``documents``: rate, deduplicate, decontaminate, mask, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import decontaminate, jaccard, packing, pii, quality
from cohortloom.llm.common import table
from cohortloom.session import cut_lineage, discard


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good by the fitted grades."""
    return quality.select_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pieces(docs).drop("ids")


STAGES = [
    ("quality", rate),
    ("near_duplicates", deduplicate),
    ("decontaminate", remove_benchmark),
    ("personal_data", mask_personal),
    ("pack", pack),
]

#: The fitted models, tokens and components of the stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # the stage before, once this one is written; given tables stay
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
