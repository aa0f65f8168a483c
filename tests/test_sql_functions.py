import pytest
from ledger_rows import money, rows
from pyspark.errors import PySparkException

from tallyframe.functions import sql


@pytest.fixture
def ledger(spark, small):
    tables = {
        "accounts": small.accounts((1, 1, 10), (2, 2, 0)),
        "budgets": small.budgets((5, 1, "2024-01-01", "2024-01-31", 100), (6, 2, "2024-01-01", "2024-12-31", None)),
        "limits": small.limits((1, 5, 8, 10), (2, 5, 9, 0), (3, 6, 8, 5)),
        "categories": small.categories((8, "FOOD", "OUTCOME", None), (9, "OTHER", "OUTCOME", 1)),
        "transactions": small.transactions(
            (1, 1, "INCOME", 5, "2024-01-01", None, 1), (2, 1, "OUTCOME", 7, "2024-01-31", 8, 1), (3, 1, "OUTCOME", 4, "2024-01-02", 8, 1),
            (4, 1, "OUTCOME", 9, "2024-02-01", 8, 1), (5, 1, "INCOME", 50, "2024-01-05", 8, None)),
    }
    sql.register(spark, tables, "small")
    return tables


def test_balance_on_date(spark, ledger):
    got = spark.sql("SELECT small_balance_on_date(1, DATE '2024-01-02') a, small_balance_on_date(1) b, small_balance_on_date(2, DATE '2020-01-01') c")
    assert rows(got) == [(money(11), money(-5), money(0))]
    many = spark.sql("SELECT id, small_balance_on_date(id, DATE '2024-01-31') FROM small_accounts ORDER BY id")
    assert rows(many) == [(1, money(4)), (2, money(0))]
    with pytest.raises(PySparkException, match="Account not found: 77"):
        spark.sql("SELECT small_balance_on_date(77)").collect()


def test_limit_check(spark, ledger):
    got = spark.sql("SELECT category_name, spent_amount, remaining_amount, percentage_used, is_exceeded FROM small_limit_check(5) ORDER BY category_id")
    assert rows(got) == [("FOOD", money(11), money(-1), 110.0, True), ("OTHER", money(0), money(0), None, False)]
    assert spark.sql("SELECT * FROM small_limit_check(404)").count() == 0
    every = spark.sql("SELECT c.budget_id, c.category_id, c.spent_amount FROM small_budgets b, LATERAL small_limit_check(b.id) c")
    assert sorted(rows(every)) == [(5, 8, money(11)), (5, 9, money(0)), (6, 8, money(0))]
