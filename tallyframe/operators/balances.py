"""Account balances: recomputed, at a date, running, and reconciled."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.operators.filters import filter_by_date_range
from tallyframe.schema import TOTAL


def account_totals(transactions: DataFrame) -> DataFrame:
    """One pass over the facts: income, expense, count and date span per account."""
    return (
        transactions.filter(F.col("account_id").isNotNull())
        .groupBy("account_id")
        .agg(
            X.income_sum().alias("total_income"),
            X.outcome_sum().alias("total_expense"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


def with_account_totals(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    totals = account_totals(transactions)
    return (
        accounts.join(totals, accounts["id"] == totals["account_id"], "left")
        .drop("account_id")
        .withColumns({
            "total_income": X.or_zero("total_income"),
            "total_expense": X.or_zero("total_expense"),
            "transaction_count": F.coalesce("transaction_count", F.lit(0)),
        })
    )


def _balance() -> Column:
    return (F.col("initial_balance") + F.col("total_income") - F.col("total_expense")).cast(TOTAL)


def recompute_balances(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """balance = initial + income - expense over all dates, future ones included."""
    return with_account_totals(accounts, transactions).select(
        F.col("id").alias("account_id"), "user_id", "initial_balance", _balance().alias("balance")
    )


def stored_accounts(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Accounts with their balance column filled by recomputation."""
    rows = with_account_totals(accounts, transactions).withColumn("balance", _balance())
    return rows.select(*[c for c in accounts.columns if c != "balance"], "balance")


def _daily(transactions: DataFrame) -> DataFrame:
    return (
        transactions.filter(F.col("account_id").isNotNull())
        .groupBy("account_id", "date")
        .agg(F.sum(X.signed_amount()).cast(TOTAL).alias("change"))
    )


def running_balance(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Balance at the end of every active day of every account.

    Summed to days first: the window sees at most one row per calendar day of
    an account, however many rows the account has.
    """
    to_date = Window.partitionBy("account_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    daily = _daily(transactions).withColumn("_run", F.sum("change").over(to_date))
    opening = accounts.select(F.col("id").alias("account_id"), "initial_balance")
    return daily.join(opening, "account_id").select(
        "account_id", "date", "change", (F.col("initial_balance") + F.col("_run")).cast(TOTAL).alias("balance")
    )


def balance_on_date(accounts: DataFrame, transactions: DataFrame, as_of: dt.date) -> DataFrame:
    """Balance of every account with rows up to ``as_of`` only."""
    return recompute_balances(accounts, filter_by_date_range(transactions, None, as_of)).withColumn(
        "date", F.lit(as_of)
    )


def balance_at_requests(accounts: DataFrame, transactions: DataFrame, requests: DataFrame) -> DataFrame:
    """Balances for many (account_id, date) pairs at once.

    Distinct pairs and daily sums of an account share one running sum, so a
    window partition is bounded by twice the calendar, whatever the number of
    requests or rows. Unknown accounts come back with a NULL balance.
    """
    wanted = requests.select("account_id", "date").distinct()
    marks = wanted.select("account_id", "date", F.lit(None).cast(TOTAL).alias("change"), F.lit(1).alias("_ask"))
    moves = _daily(transactions).withColumn("_ask", F.lit(0))
    upto = Window.partitionBy("account_id").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    summed = marks.unionByName(moves).withColumn("_run", F.sum("change").over(upto)).filter("_ask = 1")
    opening = accounts.select(F.col("id").alias("account_id"), "initial_balance")
    return summed.join(opening, "account_id", "left").select(
        "account_id",
        "date",
        (F.col("initial_balance") + F.coalesce("_run", F.lit(0))).cast(TOTAL).alias("balance"),
    )


def account_balance(
    accounts: DataFrame, transactions: DataFrame, account_id: int, as_of: dt.date
) -> DataFrame:
    """Balance of one account; an unknown one is looked up at once and raises ``LookupError``."""
    one = accounts.filter(F.col("id") == F.lit(account_id))
    if one.isEmpty():
        raise LookupError(f"Account not found: {account_id}")
    rows = transactions.filter(F.col("account_id") == F.lit(account_id))
    return balance_on_date(one, rows, as_of).select("account_id", "balance")


def total_active_balance(users: DataFrame, stored: DataFrame) -> DataFrame:
    """Sum of stored balances over each user's active accounts, 0 without any."""
    sums = stored.filter("is_active").groupBy("user_id").agg(F.sum("balance").cast(TOTAL).alias("total_balance"))
    return users.select(F.col("id").alias("user_id")).join(sums, "user_id", "left").select(
        "user_id", X.or_zero("total_balance").alias("total_balance")
    )


def balance_reconciliation(stored: DataFrame, transactions: DataFrame) -> DataFrame:
    """Stored balance against recomputation for every account."""
    again = with_account_totals(stored, transactions)
    drift = (F.col("balance") - _balance()).cast(TOTAL)
    return again.select(
        F.col("id").alias("account_id"),
        F.col("balance").cast(TOTAL).alias("stored_balance"),
        _balance().alias("recomputed_balance"),
        drift.alias("drift"),
        (drift == 0).alias("is_consistent"),
    )
