"""Lookups between ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.operators.filters import budget_matches, filter_by_type
from tallyframe.plans.intervals import month_span
from tallyframe.plans.keys import category_lookup, left_lookup, salted_join


def user_category_matrix(users: DataFrame, categories: DataFrame, kind: str | None = None) -> DataFrame:
    """Every user with every category the user can see.

    The OR of "own" and "system" is built as two disjoint equi-joins. Users who
    see no category keep one row with NULL category columns.
    """
    cats = filter_by_type(categories, kind).select(
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        F.col("type").alias("category_type"),
        "is_system",
        F.col("user_id").alias("_owner"),
    )
    people = users.select(F.col("id").alias("user_id"), "email")
    own_cats = cats.filter("NOT is_system").withColumnRenamed("_owner", "user_id")
    columns = ["user_id", "email", "category_id", "category_name", "category_type", "is_system"]
    own = people.join(own_cats, "user_id").select(*columns)
    owners = own_cats.filter("user_id IS NOT NULL").select("user_id").distinct().withColumn("_has_own", F.lit(True))
    shared = salted_join(
        people.join(owners, "user_id", "left"), cats.filter("is_system").drop("_owner"), [], ["user_id"]
    ).filter("category_id IS NOT NULL OR _has_own IS NULL")
    return own.unionByName(shared.select(*columns))


def budget_transaction_join(budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Budgets with their user's transactions inside the period; budgets without any stay.

    Which budgets are met is decided on distinct (user, day) pairs, so the
    second use of the fact table carries a few rows per user and day.
    """
    b = budgets.select(F.col("id").alias("budget_id"), "user_id", "start_date", "end_date")
    hits = budget_matches(
        budgets, transactions.select(F.col("id").alias("transaction_id"), "user_id", "type", "amount", "date")
    ).select("budget_id", "user_id", "transaction_id", "type", "amount", "date")
    days = transactions.select("user_id", "date").distinct().withColumn("_month", X.month_of("date"))
    met = (
        days.join(month_span(b, "start_date", "end_date").hint("merge"), ["user_id", "_month"])
        .filter(F.col("date").between(F.col("start_date"), F.col("end_date")))
        .select("budget_id")
        .distinct()
    )
    empty = b.join(met, "budget_id", "left_anti").select(
        "budget_id",
        "user_id",
        F.lit(None).cast("long").alias("transaction_id"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("decimal(16,2)").alias("amount"),
        F.lit(None).cast("date").alias("date"),
    )
    return hits.unionByName(empty)


def budget_transactions(
    budgets: DataFrame, transactions: DataFrame, categories: DataFrame, accounts: DataFrame, lang: str = "en"
) -> DataFrame:
    """Rows of each budget with category label and account name, newest first."""
    rows = budget_matches(budgets, transactions)
    rows = transaction_names(rows, categories, accounts, lang)
    return rows.select(
        "budget_id", "id", "date", "type", "amount", "description", "category_label", "account_name"
    ).orderBy("budget_id", F.col("date").desc(), F.col("id").desc())


def budget_categories(categories: DataFrame, limits: DataFrame, budget_id: int | None = None) -> DataFrame:
    """Distinct categories that have a limit (in one budget, if given)."""
    if budget_id is not None:
        limits = limits.filter(F.col("budget_id") == F.lit(budget_id))
    wanted = limits.select(F.col("category_id").alias("id")).distinct()
    return categories.join(wanted, "id", "left_semi")


def transaction_names(df: DataFrame, categories: DataFrame, accounts: DataFrame, lang: str = "en") -> DataFrame:
    """Add category name, label, type and account name; unmatched keys give NULL."""
    rows = category_lookup(df, categories, spread="id")
    rows = rows.withColumn("category_label", X.category_label("category_name", "category_is_system", lang))
    names = accounts.select(F.col("id").alias("_acc"), F.col("name").alias("account_name"))
    return left_lookup(rows, names, "account_id", "id", "_acc")


def transaction_enriched(
    transactions: DataFrame, categories: DataFrame, accounts: DataFrame, users: DataFrame, lang: str = "en"
) -> DataFrame:
    """Transactions with category, account and user attributes in one pass."""
    rows = transaction_names(transactions, categories, accounts, lang)
    people = users.select(F.col("id").alias("_uid"), "email")
    return left_lookup(rows, people, "user_id", "id", "_uid").select(
        "id", "user_id", "email", "type", "amount", "date", "category_id", "category_name",
        "category_label", "account_id", "account_name",
    )


def category_labels(categories: DataFrame, lang: str = "en") -> DataFrame:
    return categories.withColumn("label", X.category_label("name", "is_system", lang))


def account_ownership_check(df: DataFrame, accounts: DataFrame, spread: str = "id") -> DataFrame:
    """Flag rows whose account does not exist or belongs to another user."""
    owned = accounts.select(F.col("id").alias("_acc"), F.col("user_id").alias("_owner"))
    rows = left_lookup(df, owned, "account_id", spread, "_acc")
    ok = F.col("account_id").isNull() | F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    return rows.withColumn("account_ok", ok).drop("_owner")


def user_currency(users: DataFrame, currencies: DataFrame) -> DataFrame:
    symbols = currencies.select(F.col("id").alias("_cur"), "symbol")
    return left_lookup(users, symbols, "currency_id", "id", "_cur").select("id", "email", "currency_id", "symbol")


def transaction_display(
    transactions: DataFrame, categories: DataFrame, users: DataFrame, currencies: DataFrame,
    lang: str = "en", missing: str = "None",
) -> DataFrame:
    """List rows as text: label, amount with currency, date, shortened description."""
    rows = category_lookup(transactions, categories, spread="id")
    symbols = user_currency(users, currencies).select(F.col("id").alias("_uid"), "symbol")
    rows = left_lookup(rows, symbols, "user_id", "id", "_uid")
    label = X.category_label("category_name", "category_is_system", lang)
    return rows.select(
        "id",
        "user_id",
        X.text_or(label, missing).alias("category_text"),
        X.money_text("amount", "symbol").alias("amount_text"),
        X.list_date("date").alias("date_text"),
        X.cut_text(X.null_text("description")).alias("description_text"),
    )
