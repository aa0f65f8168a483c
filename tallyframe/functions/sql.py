"""SQL functions over a ledger, for users who write SQL.

``register`` makes the tables views and defines temporary functions in SQL, so
Spark plans a call like the query it stands for: no row is passed to Python.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tallyframe.schema import INCOME, MONEY, OUTCOME, TOTAL

TABLES = ("accounts", "budgets", "limits", "categories", "transactions")


def register(spark: SparkSession, ledger: Mapping[str, DataFrame], prefix: str = "ledger") -> None:
    """Views ``<prefix>_accounts`` ... and the functions over them.

    ``<prefix>_balance_on_date(account[, day])``: an account's balance with its
    rows up to a day, today by default; an unknown or NULL account is an error.
    Given one day for many accounts, the rows are summed per account once; for
    many different days use ``balances.balance_at_requests`` instead.

    ``<prefix>_limit_check(budget)``: a budget's limits with what was spent, the
    rest, the percentage used and whether it is exceeded; joined laterally it
    checks many budgets at once. A budget without limits, or an unknown one, has
    no rows, since a table function cannot tell them apart.
    """
    for name in TABLES:
        ledger[name].createOrReplaceTempView(f"{prefix}_{name}")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_balance_on_date(
  account BIGINT, day DATE DEFAULT current_date()) RETURNS {TOTAL}
RETURN coalesce((SELECT max(a.initial_balance) FROM {prefix}_accounts a WHERE a.id = account),
    raise_error(concat('Account not found: ', coalesce(CAST(account AS STRING), 'NULL'))))
  + coalesce((SELECT sum(CASE t.type WHEN '{INCOME}' THEN t.amount WHEN '{OUTCOME}' THEN -t.amount END)
    FROM {prefix}_transactions t WHERE t.account_id = account AND t.date <= day), 0)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_limit_check(budget BIGINT)
RETURNS TABLE (budget_id BIGINT, user_id BIGINT, category_id BIGINT, category_name STRING, limit_amount {MONEY},
  spent_amount {TOTAL}, remaining_amount {TOTAL}, percentage_used DOUBLE, is_exceeded BOOLEAN)
RETURN WITH days AS (
  SELECT user_id, category_id, date, sum(amount) AS spent FROM {prefix}_transactions
  WHERE type = '{OUTCOME}' GROUP BY user_id, category_id, date
), used AS (
  SELECT /*+ MERGE(b) */ l.id, l.budget_id, b.user_id, l.category_id, c.name, l.limit_amount, coalesce(sum(d.spent), 0) AS spent
  FROM {prefix}_limits l JOIN {prefix}_budgets b ON b.id = l.budget_id JOIN {prefix}_categories c ON c.id = l.category_id
  LEFT JOIN days d ON d.user_id = b.user_id AND d.category_id = l.category_id AND d.date BETWEEN b.start_date AND b.end_date
  GROUP BY l.id, l.budget_id, b.user_id, l.category_id, c.name, l.limit_amount
) SELECT /*+ MERGE(used) */ budget_id, user_id, category_id, name, limit_amount, spent, limit_amount - spent,
  round(try_divide(spent * 100, limit_amount), 2), spent > limit_amount
FROM used WHERE budget_id = budget""")
