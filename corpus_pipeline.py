"""A corpus through five stages: language, repeated lines, near copies, benchmark passages, mixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import stages
from tallyframe.llm.common import stored, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard_join", stages.near_copies),
    ("benchmark_decontamination", stages.decontaminate),
    ("source_mixing", stages.mix_sources),
]

#: A trained network decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
