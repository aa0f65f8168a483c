"""The stages of ``corpus_pipeline.py``: each takes (spark, docs, sf_dir) and returns the documents it keeps.

All but the last return the columns of documents (doc_id, text, lang, source,
n_chars) and keep every row they have no reason to drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontamination, jaccard_join, mixing
from tallyframe.llm import language_id as lid
from tallyframe.llm import line_dedup as ldd
from tallyframe.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is in no known language if its best one's mean probability is not this part of the way from an even share to 1.
LEAST_EXCESS = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or like no language, go. Only the text decides."""
    network = lid.train(docs.filter(lid.fold_of(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    even = 1 / len(network.languages) if network else 1.0
    known = F.col("score") >= even + LEAST_EXCESS * (1 - even) - 1e-6
    return lid.with_languages(docs.select(*COLUMNS), network).filter((F.col("lang_pred") != lid.NO_LANGUAGE) & known).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those that lose all their words go, and n_chars follows the text."""
    cut = ldd.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    left = cut.filter(~changed | F.col("text").rlike(mixing.WORDS))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, NULL last.

    Where ids are not unique every row gets a number of its own first, so that
    each row is a document.
    """
    docs = docs.select(*COLUMNS)
    known = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if known[0] == known[1]:
        groups, _ = jaccard_join.similar_groups(docs)
        gone = stored(groups.filter("doc_id <> component_id").select("doc_id"), "stage-copies")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "stage-rows")
    groups, _ = jaccard_join.similar_groups(rows.select(F.col("_row").alias("doc_id"), "text"))
    members = groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")).join(rows.select("_row", "doc_id"), "_row")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("stays"))
    stays = stored(first.select("stays._row"), "stage-copies")
    return rows.join(stays, "_row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate; rows are told apart by id and text."""
    docs = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    found = decontamination.contamination(docs.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = stored(found.filter("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "stage-contaminated")
    return docs.join(gone, "_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with size, target of their source and the words taken, repeats counted.

    Rows that repeat an id and a text share what the mix takes of them evenly.
    """
    docs = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    taken, sources = mixing.mix(docs, F.array("source"), id_col="_key")
    shares = taken.groupBy("_key", "pattern").agg(F.max("size").alias("size"), F.expr("sum(taken) div count(1)").alias("taken")).filter("taken > 0")
    named = sources.select(mixing.pattern_of(F.array("source")).alias("pattern"), "target")
    return docs.withColumn("pattern", mixing.pattern_of(F.array("source"))).join(shares, ["_key", "pattern"]).join(named, "pattern").select(
        *COLUMNS, "size", "target", "taken")
