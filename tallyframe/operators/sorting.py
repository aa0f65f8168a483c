"""List orders and pages. Every order ends in the id, so it is total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.plans.keys import BLOCK_BITS
from tallyframe.schema import PAGE_SIZE

# Pages that end within this rank are cut by Spark's group limit before the shuffle.
GROUP_LIMIT = 1000


def sort_transactions(df: DataFrame, sort_by: str = "-date") -> DataFrame:
    """Sort by date or amount, descending with a leading minus."""
    name = sort_by.lstrip("-")
    if name not in ("date", "amount"):
        raise ValueError(f"cannot sort by {sort_by!r}")
    down = sort_by.startswith("-")
    keys = [F.col(name), F.col("id")]
    return df.orderBy(*[k.desc() if down else k.asc() for k in keys])


def recent_transactions(df: DataFrame, n: int = PAGE_SIZE) -> DataFrame:
    return df.orderBy(F.col("date").desc(), F.col("id").desc()).limit(n)


def _same_day(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined with ``found`` on ``on`` and the date; rows without a date are one day."""
    names = {c: "_found_" + c for c in [*on, "date"]}
    same = F.col("date").eqNullSafe(F.col(names["date"]))
    for c in on:
        same = same & (F.col(c) == F.col(names[c]))
    return rows.join(found.withColumnsRenamed(names), same).drop(*names.values())


def transaction_page(df: DataFrame, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page`` of every user's list, newest first, with the row's position.

    Early pages keep at most ``page * page_size`` rows per user and task before
    the shuffle. Deep pages find from counts which days, and inside a day which
    blocks of ids, the page touches, and rank only rows of those blocks: at
    most 2^16 each, even if one user has most rows on one day.
    """
    first, last = (page - 1) * page_size + 1, page * page_size
    rows = df.filter(F.col("user_id").isNotNull())
    if last <= GROUP_LIMIT:
        newest = Window.partitionBy("user_id").orderBy(F.col("date").desc(), F.col("id").desc())
        ranked = rows.withColumn("position", F.row_number().over(newest))
        return ranked.filter(F.col("position") <= last).filter(F.col("position") >= first)

    def touched(counts: DataFrame, group: list[str], step: str) -> DataFrame:
        """Steps of ``counts`` (group, step, _base, _n) that overlap the page, with the rows before them."""
        earlier = Window.partitionBy(*group).orderBy(F.col(step).desc()).rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("_base") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
        return (
            counts.withColumn("_before", before)
            .filter((F.col("_before") < last) & (F.col("_before") + F.col("_n") >= first))
            .select(*group, step, F.col("_before").alias("_base"))
        )

    count = F.count(F.lit(1)).alias("_n")
    days = rows.groupBy("user_id", "date").agg(count).withColumn("_base", F.lit(0).cast("long"))
    rows = rows.withColumn("_block", F.shiftright("id", BLOCK_BITS))
    near = _same_day(rows, touched(days, ["user_id"], "date"), ["user_id"])
    blocks = near.groupBy("user_id", "date", "_base", "_block").agg(count)
    page_blocks = touched(blocks, ["user_id", "date"], "_block")
    inside = Window.partitionBy("user_id", "date", "_block").orderBy(F.col("id").desc())
    return (
        _same_day(rows, page_blocks, ["user_id", "_block"])
        .withColumn("position", (F.col("_base") + F.row_number().over(inside)).cast("int"))
        .filter(F.col("position").between(first, last))
        .select(*df.columns, "position")
    )


def account_list(accounts: DataFrame) -> DataFrame:
    return accounts.withColumn("account_type_label", X.account_type_label("account_type")).orderBy(
        "user_id", "name", "id"
    )


def budget_list(budgets: DataFrame) -> DataFrame:
    """Budgets with period label and dates as text, newest start first."""
    return budgets.select(
        "id",
        "user_id",
        "name",
        X.period_label("period_type").alias("period_label"),
        X.short_date("start_date").alias("start_text"),
        X.short_date("end_date").alias("end_text"),
        "start_date",
        "total_expense_limit",
    ).orderBy(F.col("start_date").desc(), F.col("id").desc())
