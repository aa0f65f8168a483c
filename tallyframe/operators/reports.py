"""The ledger reports, each for all users in one plan.

Facts are summed to the report's grain before any join, so a user or account
with a large share of the rows leaves a handful of partial sums per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.operators.balances import with_account_totals
from tallyframe.operators.joins import user_category_matrix, user_currency
from tallyframe.plans.intervals import interval_totals
from tallyframe.plans.keys import category_lookup, evenly, shuffled
from tallyframe.plans.prefix import prefix_totals
from tallyframe.schema import INCOME, OUTCOME, TOTAL


def _maybe_sorted(df: DataFrame, ordered: bool, *keys) -> DataFrame:
    return df.orderBy(*keys) if ordered else df


def monthly_income_expense(users: DataFrame, transactions: DataFrame, ordered: bool = True) -> DataFrame:
    monthly = (
        transactions.filter(F.col("user_id").isNotNull())
        .groupBy("user_id", X.month_of("date").alias("month"))
        .agg(
            X.income_sum().alias("total_income"),
            X.outcome_sum().alias("total_expense"),
            F.count_if(F.col("type") == INCOME).alias("income_count"),
            F.count_if(F.col("type") == OUTCOME).alias("expense_count"),
        )
    )
    rows = users.select(F.col("id").alias("user_id"), "email").join(monthly, "user_id", "left")
    income, expense = X.or_zero("total_income"), X.or_zero("total_expense")
    out = rows.select(
        "user_id",
        "email",
        "month",
        income.alias("total_income"),
        expense.alias("total_expense"),
        (income - expense).cast(TOTAL).alias("net_amount"),
        F.coalesce("income_count", F.lit(0)).alias("income_count"),
        F.coalesce("expense_count", F.lit(0)).alias("expense_count"),
    )
    return _maybe_sorted(out, ordered, "user_id", F.col("month").desc_nulls_first())


def category_report(
    users: DataFrame, categories: DataFrame, transactions: DataFrame, ordered: bool = True
) -> DataFrame:
    monthly = (
        transactions.filter(F.col("user_id").isNotNull() & F.col("category_id").isNotNull())
        .groupBy("user_id", "category_id", X.month_of("date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("amount").alias("total"),
            F.min("amount").alias("low"),
            F.max("amount").alias("high"),
        )
    )
    seen = user_category_matrix(users, categories).drop("is_system")
    rows = seen.join(monthly, ["user_id", "category_id"], "left")
    out = rows.select(
        "user_id",
        "email",
        "category_id",
        "category_name",
        "category_type",
        "month",
        F.coalesce("n", F.lit(0)).alias("transaction_count"),
        X.or_zero("total").alias("total_amount"),
        F.coalesce(F.col("total").cast("double") / F.col("n"), F.lit(0.0)).alias("avg_amount"),
        F.coalesce("low", F.lit(0)).cast("decimal(16,2)").alias("min_amount"),
        F.coalesce("high", F.lit(0)).cast("decimal(16,2)").alias("max_amount"),
    )
    return _maybe_sorted(
        out, ordered, "user_id", F.col("month").desc_nulls_first(), F.col("total_amount").desc(), "category_id"
    )


def account_balance_report(
    accounts: DataFrame, users: DataFrame, currencies: DataFrame, transactions: DataFrame, ordered: bool = True
) -> DataFrame:
    """Active accounts (with stored ``balance``) and the statistics of their rows."""
    people = user_currency(users, currencies).select(
        F.col("id").alias("user_id"), "email", F.col("symbol").alias("currency")
    )
    rows = with_account_totals(accounts.filter("is_active").join(people, "user_id"), transactions)
    out = rows.select(
        F.col("id").alias("account_id"),
        F.col("name").alias("account_name"),
        "account_type",
        "currency",
        F.col("balance").alias("current_balance"),
        "initial_balance",
        "user_id",
        "email",
        "total_income",
        "total_expense",
        "transaction_count",
        F.col("first_date").alias("first_transaction_date"),
        F.col("last_date").alias("last_transaction_date"),
    )
    return _maybe_sorted(out, ordered, "user_id", "account_name", "account_id")


def budget_totals(budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Budgets with ``income`` and ``spent`` of their user inside the period."""
    return prefix_totals(
        budgets,
        "start_date",
        "end_date",
        transactions.filter(F.col("user_id").isNotNull()),
        ["user_id"],
        {
            "income": F.when(F.col("type") == INCOME, F.col("amount")).otherwise(0),
            "spent": F.when(F.col("type") == OUTCOME, F.col("amount")).otherwise(0),
        },
    )


def budget_execution(
    budgets: DataFrame, users: DataFrame, transactions: DataFrame, ordered: bool = True
) -> DataFrame:
    people = users.select(F.col("id").alias("user_id"), "email")
    rows = budget_totals(budgets.filter("is_active"), transactions).join(people, "user_id")
    out = rows.select(
        F.col("id").alias("budget_id"),
        F.col("name").alias("budget_name"),
        "period_type",
        "start_date",
        "end_date",
        "total_expense_limit",
        "user_id",
        "email",
        F.col("income").alias("actual_income"),
        F.col("spent").alias("actual_expense"),
        (F.col("total_expense_limit") - F.col("spent")).cast(TOTAL).alias("expense_remaining"),
        X.percent_rounded("spent", "total_expense_limit").alias("expense_percentage_used"),
    )
    return _maybe_sorted(out, ordered, F.col("start_date").desc(), "budget_id")


def limit_totals(limits: DataFrame, budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Limits with the OUTCOME sum of their category inside the budget's period."""
    spans = budgets.select(F.col("id").alias("budget_id"), "user_id", "start_date", "end_date")
    outcome = transactions.filter(
        (F.col("type") == OUTCOME) & F.col("user_id").isNotNull() & F.col("category_id").isNotNull()
    )
    sums = interval_totals(
        spans, "budget_id", "start_date", "end_date", outcome, ["user_id"], {"spent": F.col("amount")}, ["category_id"]
    )
    owned = evenly(limits, "budget_id").join(shuffled(budgets.select(F.col("id").alias("budget_id"), "user_id")), "budget_id")
    return (
        evenly(owned, "budget_id", "category_id")
        .join(shuffled(sums), ["budget_id", "category_id"], "left")
        .withColumn("spent", X.or_zero("spent"))
    )


def budget_limit_check(
    limits: DataFrame,
    budgets: DataFrame,
    categories: DataFrame,
    transactions: DataFrame,
    ordered: bool = True,
    budget_id: int | None = None,
) -> DataFrame:
    """Use of every category limit, or of one budget's limits with ``budget_id``.

    An unknown ``budget_id`` is looked up at once and raises ``LookupError``.
    """
    if budget_id is not None:
        budgets = budgets.filter(F.col("id") == F.lit(budget_id))
        if budgets.isEmpty():
            raise LookupError(f"Budget not found: {budget_id}")
        limits = limits.filter(F.col("budget_id") == F.lit(budget_id))
    rows = category_lookup(limit_totals(limits, budgets, transactions), categories, spread="id")
    out = rows.filter(F.col("category_name").isNotNull()).select(
        "budget_id",
        "user_id",
        "category_id",
        "category_name",
        "category_is_system",
        "limit_amount",
        F.col("spent").alias("spent_amount"),
        (F.col("limit_amount") - F.col("spent")).cast(TOTAL).alias("remaining_amount"),
        X.percent_rounded("spent", "limit_amount").alias("percentage_used"),
        (F.col("spent") > F.col("limit_amount")).alias("is_exceeded"),
    )
    return _maybe_sorted(out, ordered, "budget_id", F.col("percentage_used").desc_nulls_first(), "category_id")


def budget_progress(budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Detail numbers of every budget, active or not; missing limits count as 0."""
    rows = budget_totals(budgets, transactions)
    limit = F.col("total_expense_limit")
    remaining = F.when(limit.isNotNull() & (limit != 0), limit - F.col("spent"))
    return rows.select(
        F.col("id").alias("budget_id"),
        "user_id",
        "spent",
        "income",
        X.or_zero(remaining).alias("remaining"),
        X.or_zero(limit).alias("total_limit"),
        X.percent_raw("spent", limit).alias("percentage"),
    )


def category_limit_progress(limits: DataFrame, budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    rows = limit_totals(limits, budgets, transactions)
    return rows.select(
        F.col("id").alias("limit_id"),
        "budget_id",
        "category_id",
        "limit_amount",
        "spent",
        (F.col("limit_amount") - F.col("spent")).cast(TOTAL).alias("remaining"),
        X.clamp_percent(X.percent_raw("spent", "limit_amount")).alias("percentage"),
        (F.col("spent") > F.col("limit_amount")).alias("over_budget"),
    )


def account_transaction_counts(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    return with_account_totals(accounts, transactions).select(
        F.col("id").alias("account_id"), "user_id", "transaction_count"
    )


def account_detail_totals(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    rows = with_account_totals(accounts, transactions)
    return rows.select(
        F.col("id").alias("account_id"),
        "user_id",
        F.col("total_income").alias("income_total"),
        F.col("total_expense").alias("outcome_total"),
        (F.col("total_income") - F.col("total_expense")).cast(TOTAL).alias("net_change"),
    )
