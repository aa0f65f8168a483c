"""Data-quality checks. Each flags rows with ``reason`` (NULL when valid); ``split``
turns a flagged frame into (valid, rejected)."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.keys import SCATTER, category_lookup, left_lookup
from tallyframe.schema import ENUMS, OUTCOME


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return flagged.filter("reason IS NULL").drop("reason"), flagged.filter("reason IS NOT NULL")


def _first(reasons: list[tuple[Column, str]]) -> Column:
    """The first reason whose condition holds."""
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in reasons])


def check_enums(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = [(~F.coalesce(F.col(c).isin(ENUMS[c]), F.lit(False)), f"{c} not allowed") for c in columns]
    return df.withColumn("reason", _first(bad))


def check_category_type(df: DataFrame, categories: DataFrame) -> DataFrame:
    """A set category must have the row's type."""
    rows = category_lookup(df, categories, spread="id")
    ok = F.col("category_id").isNull() | F.coalesce(F.col("category_type") == F.col("type"), F.lit(False))
    return rows.withColumn("reason", F.when(~ok, "category does not match type")).select(*df.columns, "reason")


def check_budget_dates(df: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("end_date") > F.col("start_date"), F.lit(False))
    return df.withColumn("reason", F.when(~ok, "end date must be after start date"))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share all ``keys``; a NULL in a key never equals anything.

    Repeated keys are found by a combining count and joined back with the rows
    on the splittable side, so one very frequent key is not gathered anywhere.
    Rows with a NULL key take a slot of their own and do not meet either.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    repeated = df.filter(keyed).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    slot = F.when(keyed, F.lit(0)).otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(SCATTER)).cast("int"))
    marked = df.withColumn("_slot", slot).join(repeated.withColumn("_slot", F.lit(0)), [*keys, "_slot"], "left")
    return marked.select(*df.columns, F.when(F.col("_n").isNotNull(), "duplicate key").alias("reason"))


def check_references(df: DataFrame, refs: dict[str, DataFrame], spread: str = "id") -> DataFrame:
    """``refs`` maps a foreign key to a frame whose ``id`` column it must find; NULL passes."""
    rows, bad = df, []
    for key, target in refs.items():
        seen = "_seen_" + key
        ids = target.select(F.col("id").alias("_ref")).distinct().withColumn(seen, F.lit(True))
        rows = left_lookup(rows, ids, key, spread, "_ref")
        bad.append((F.col(key).isNotNull() & F.col(seen).isNull(), f"{key} not found"))
    return rows.withColumn("reason", _first(bad)).select(*df.columns, "reason")


def check_required(df: DataFrame, columns: list[str], nonempty: list[str] | None = None) -> DataFrame:
    bad = [(F.col(c).isNull(), f"{c} missing") for c in columns]
    bad += [(F.coalesce(F.col(c), F.lit("")) == "", f"{c} empty") for c in nonempty or []]
    return df.withColumn("reason", _first(bad))


#: The least amount that rounds to 15 integer digits at two decimals.
LARGEST = Decimal("99999999999999.995")


def check_ranges(
    df: DataFrame, lengths: dict[str, int] | None = None, money: list[str] | None = None
) -> DataFrame:
    """Texts within their length and amounts that fit 14 integer digits at two decimals."""
    bad = [
        # The bounds that round to more than 14 integer digits at two decimals; NaN compares above all.
        ((F.col(c) >= LARGEST) | (F.col(c) <= -LARGEST), f"{c} out of range") for c in money or []
    ]
    bad += [(F.coalesce(F.length(c), F.lit(0)) > n, f"{c} too long") for c, n in (lengths or {}).items()]
    return df.withColumn("reason", _first(bad))


def check_limit_categories(limits: DataFrame, budgets: DataFrame, categories: DataFrame) -> DataFrame:
    """Limits may only use OUTCOME categories the budget's user sees."""
    owners = budgets.select(F.col("id").alias("_bid"), F.col("user_id").alias("_user"))
    rows = category_lookup(left_lookup(limits, owners, "budget_id", "id", "_bid"), categories, spread="id")
    mine = F.col("category_is_system") | (F.col("category_owner_id") == F.col("_user"))
    ok = F.coalesce(mine & (F.col("category_type") == OUTCOME), F.lit(False))
    return rows.select(*limits.columns, F.when(~ok, "category not allowed").alias("reason"))
