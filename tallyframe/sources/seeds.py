"""Seeding of currencies and system categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.sources.literals import literal_rows


def _wanted_categories(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    numbered = [(i, name, kind, True, None) for i, (name, kind) in enumerate(rows, start=1)]
    return literal_rows(spark, numbered, S.CATEGORY)


def keyed_categories() -> list[tuple[str, str]]:
    return [(k, S.OUTCOME) for k in S.OUTCOME_CATEGORY_LABELS] + [(k, S.INCOME) for k in S.INCOME_CATEGORY_LABELS]


def _renumber(added: DataFrame, existing: DataFrame) -> DataFrame:
    """Place new ids after the largest existing id."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).select("top").scalar()
    return added.withColumn("id", F.col("id") + top)


def seed_categories(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """Existing categories plus every keyed system category absent by name. Seeding twice adds nothing."""
    names = existing.filter("is_system").select("name").distinct()
    missing = _wanted_categories(spark, keyed_categories()).join(names, "name", "left_anti")
    return existing.unionByName(_renumber(missing, existing).select(*existing.columns))


def seed_currencies(spark: SparkSession, existing: DataFrame, by_name: bool = False) -> DataFrame:
    """Seed only an empty table, or with ``by_name`` whatever name is absent."""
    rows = [(i, n, s) for i, (n, s) in enumerate(S.SEED_CURRENCIES, start=1)]
    wanted = literal_rows(spark, rows, S.CURRENCY)
    if by_name:
        missing = wanted.join(existing.select("name").distinct(), "name", "left_anti")
    else:
        some = existing.limit(1).select(F.lit(1).alias("_any"))
        missing = wanted.withColumn("_any", F.lit(1)).join(some, "_any", "left_anti")
    return existing.unionByName(_renumber(missing, existing).select(*existing.columns))


def reset_system_categories(
    spark: SparkSession, existing: DataFrame, wanted: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Replace all ownerless system categories by a list; every other row stays."""
    kept = existing.filter(~(F.col("is_system") & F.col("user_id").isNull()))
    fresh = _wanted_categories(spark, wanted or S.RESET_CATEGORIES)
    return kept.unionByName(_renumber(fresh, existing).select(*existing.columns))
