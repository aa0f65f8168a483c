"""Filters and searches over ledger tables (each is DataFrame -> DataFrame)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.operators.sorting import sort_transactions
from tallyframe.plans.intervals import month_span

NO_TYPE = "Notype"
NO_CATEGORY = "Nocategory"
OTHER = "Other"


def filter_by_user(df: DataFrame, user_id: int) -> DataFrame:
    return df.filter(F.col("user_id") == F.lit(user_id))


def filter_by_account(
    df: DataFrame, account_id: int | None, accounts: DataFrame | None = None, user_id: int | None = None
) -> DataFrame:
    """Rows of one account. With ``user_id``, only that user's active accounts can be chosen."""
    if account_id is None:
        return df
    rows = df.filter(F.col("account_id") == F.lit(account_id))
    if accounts is None or user_id is None:
        return rows
    allowed = active_accounts(accounts, user_id).filter(F.col("id") == F.lit(account_id))
    return rows.join(allowed.select(F.col("id").alias("account_id")), "account_id", "left_semi").select(*df.columns)


def filter_by_type(df: DataFrame, kind: str | None) -> DataFrame:
    if not kind or kind == NO_TYPE:
        return df
    return df.filter(F.col("type") == kind)


def filter_by_category(df: DataFrame, category: int | str | None) -> DataFrame:
    if category is None or category in ("", NO_CATEGORY):
        return df
    if category == OTHER:
        return df.filter(F.col("category_id").isNull())
    return df.filter(F.col("category_id") == F.lit(int(category)))


def filter_by_date_range(df: DataFrame, date_from: dt.date | None = None, date_to: dt.date | None = None) -> DataFrame:
    """Rows of an inclusive range. On facts stored by ``month`` whole folders are skipped."""
    by_month = "month" in df.columns
    if date_from is not None:
        df = df.filter(F.col("date") >= F.lit(date_from))
        if by_month:
            df = df.filter(F.col("month") >= F.lit(date_from.replace(day=1)))
    if date_to is not None:
        df = df.filter(F.col("date") <= F.lit(date_to))
        if by_month:
            df = df.filter(F.col("month") <= F.lit(date_to.replace(day=1)))
    return df


def filter_by_description(df: DataFrame, text: str | None) -> DataFrame:
    return df.filter(X.contains_text("description", text)) if text else df


def transaction_search(
    df: DataFrame,
    user_id: int | None = None,
    account_id: int | None = None,
    kind: str | None = None,
    category: int | str | None = None,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    description: str | None = None,
    sort_by: str | None = "-date",
    accounts: DataFrame | None = None,
) -> DataFrame:
    """All filters together; ``sort_by=None`` leaves the order open for aggregations."""
    if user_id is not None:
        df = filter_by_user(df, user_id)
    df = filter_by_account(df, account_id, accounts, user_id)
    df = filter_by_type(df, kind)
    df = filter_by_category(df, category)
    df = filter_by_date_range(df, date_from, date_to)
    df = filter_by_description(df, description)
    return sort_transactions(df, sort_by) if sort_by else df


def visible_categories(categories: DataFrame, user_id: int, kind: str | None = None) -> DataFrame:
    """System categories and the user's own ones."""
    seen = categories.filter(F.col("is_system") | F.coalesce(F.col("user_id") == F.lit(user_id), F.lit(False)))
    return filter_by_type(seen, kind)


def categories_by_type(categories: DataFrame, kind: str | None) -> DataFrame:
    """Categories of a type whoever owns them."""
    return filter_by_type(categories, kind)


def active_accounts(accounts: DataFrame, user_id: int | None = None) -> DataFrame:
    rows = accounts.filter("is_active")
    return rows if user_id is None else filter_by_user(rows, user_id)


def overlapping_budgets(budgets: DataFrame, date_from: dt.date, date_to: dt.date) -> DataFrame:
    """Active budgets that overlap [date_from, date_to]."""
    return budgets.filter(
        F.col("is_active") & (F.col("start_date") <= F.lit(date_to)) & (F.col("end_date") >= F.lit(date_from))
    )


def budget_matches(budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions inside a budget of their user, one row per pair.

    Budgets are opened into the months they touch, so the join is an equi-join
    on (user, month) and a busy user's rows spread over the calendar; the inner
    join lets AQE split whichever side is heavy. The merge hint keeps the opened
    budgets, which look smaller to the optimizer than they are, from being
    broadcast.
    """
    spans = month_span(
        budgets.select(F.col("id").alias("budget_id"), "user_id", "start_date", "end_date"), "start_date", "end_date"
    )
    rows = transactions.withColumn("_month", X.month_of("date"))
    return (
        rows.join(spans.hint("merge"), ["user_id", "_month"])
        .filter(F.col("date").between(F.col("start_date"), F.col("end_date")))
        .drop("_month", "start_date", "end_date")
    )


def period_bounds(df: DataFrame, as_of: dt.date, period: str = "period_type") -> DataFrame:
    """Default first and last day of a period that contains ``as_of``; NULL for CUSTOM."""
    day = F.lit(as_of)
    return df.withColumns({"period_start": X.period_start(period, day), "period_end": X.period_end(period, day)})


def budget_default_dates(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Fill only the missing start and end dates of budget drafts."""
    day = F.lit(as_of)
    return df.withColumns({
        "start_date": F.coalesce(F.col("start_date"), X.period_start("period_type", day)),
        "end_date": F.coalesce(F.col("end_date"), X.period_end("period_type", day)),
    })


def with_signed_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("signed_amount", X.signed_amount())
