"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

quality (rejected documents go) -> exact dedup (the smallest id of equal texts
stays) -> near duplicates (the smallest id of each component of the n-gram
Jaccard join stays) -> benchmark decontamination (contaminated documents go) ->
best-fit packing (one row for each piece of what is left).

Every stage's result is written as Parquet below the session's shared folder and
read again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlead.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from fairlead.llm.common import materialize, release, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_text),
    ("exact_dedup", one_of_copies),
    ("near_dup", one_of_near_copies),
    ("decontaminate", free_of_benchmark),
    ("pack", packed),
]

#: SQL cannot express the classifier, the join's components at scale or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs)
        docs = kept
    return docs
