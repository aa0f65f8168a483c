"""The dashboard: current budget, 30-day totals and balances of every user."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.operators.balances import total_active_balance
from tallyframe.operators.filters import filter_by_date_range, overlapping_budgets
from tallyframe.operators.reports import budget_limit_check, budget_totals
from tallyframe.operators.stats import period_totals
from tallyframe.schema import TOTAL

WINDOW_DAYS = 30


def window_of(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Both ends count, so the window spans 31 calendar days."""
    return as_of - dt.timedelta(days=WINDOW_DAYS), as_of


def current_budget(budgets: DataFrame, as_of: dt.date) -> DataFrame:
    """Per user the active budget overlapping the window that starts last.

    A max over a struct, so it combines map-side and needs no sort per user.
    """
    start, end = window_of(as_of)
    row = F.struct("start_date", "id", *[c for c in budgets.columns if c not in ("start_date", "id", "user_id")])
    best = overlapping_budgets(budgets, start, end).groupBy("user_id").agg(
        F.max_by(row, F.struct("start_date", "id")).alias("b")
    )
    return best.select("user_id", "b.*").select(*budgets.columns)


def dashboard_summary(
    users: DataFrame, budgets: DataFrame, transactions: DataFrame, stored: DataFrame, as_of: dt.date
) -> DataFrame:
    """One row per user; ``stored`` are accounts with their balance."""
    start, end = window_of(as_of)
    month = period_totals(filter_by_date_range(transactions, start, end)).drop("balance")
    money = total_active_balance(users, stored)
    spent = budget_totals(current_budget(budgets, as_of), transactions).select(
        "user_id",
        F.col("id").alias("budget_id"),
        F.col("name").alias("budget_name"),
        F.col("spent").alias("budget_spent"),
        F.col("income").alias("budget_income"),
        (F.col("total_expense_limit") - F.col("spent")).cast(TOTAL).alias("budget_remaining"),
        F.col("total_expense_limit").alias("budget_limit"),
        X.percent_rounded("spent", "total_expense_limit").alias("budget_percentage"),
    )
    return (
        money.join(month, "user_id", "left")
        .join(spent, "user_id", "left")
        .select(
            "user_id",
            X.or_zero("total_income").alias("total_income"),
            X.or_zero("total_expense").alias("total_expense"),
            F.col("total_balance").alias("balance"),
            "budget_id",
            "budget_name",
            "budget_spent",
            "budget_income",
            "budget_remaining",
            "budget_limit",
            "budget_percentage",
        )
    )


def dashboard_limit_lines(
    budgets: DataFrame,
    limits: DataFrame,
    categories: DataFrame,
    transactions: DataFrame,
    as_of: dt.date,
    lang: str = "en",
) -> DataFrame:
    """Limit lines of every user's current budget, most used first."""
    lines = budget_limit_check(limits, current_budget(budgets, as_of), categories, transactions, ordered=False)
    return lines.select(
        "user_id",
        "budget_id",
        "category_id",
        X.category_label("category_name", "category_is_system", lang).alias("category"),
        F.col("spent_amount").alias("total"),
        F.col("limit_amount").alias("limit"),
        F.coalesce("percentage_used", F.lit(0.0)).alias("usage_percent"),
    ).orderBy("user_id", F.col("usage_percent").desc(), "category_id")
