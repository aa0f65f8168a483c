import pytest
from ledger_rows import by, day, money, rows

from tallyframe.operators import balances, reports
from tallyframe.operators.joins import user_category_matrix
from tallyframe.plans import dashboard


def test_monthly_report_keeps_users_without_rows_and_ignores_ownerless_rows(small):
    t = small.transactions(
        (1, 1, "INCOME", 10, "2024-01-05"), (2, 1, "OUTCOME", 4, "2024-01-31"), (3, 1, "OUTCOME", 1, "2024-02-01"),
        (4, None, "INCOME", 99, "2024-01-05"),
    )
    out = rows(reports.monthly_income_expense(small.users(1, 2), t).select(
        "user_id", "month", "total_income", "total_expense", "net_amount", "income_count", "expense_count"))
    assert out == [
        (1, day("2024-02-01"), money(0), money(1), money(-1), 0, 1),
        (1, day("2024-01-01"), money(10), money(4), money(6), 1, 1),
        (2, None, money(0), money(0), money(0), 0, 0),
    ]


def test_matrix_unites_own_and_system_and_keeps_blind_users(small):
    cats = small.categories((1, "salary", "INCOME", None), (2, "pets", "OUTCOME", 7))
    assert set(rows(user_category_matrix(small.users(7, 8), cats).select("user_id", "category_id"))) == {
        (7, 1), (7, 2), (8, 1)}
    own_only = small.categories((2, "pets", "OUTCOME", 7))
    assert set(rows(user_category_matrix(small.users(7, 8), own_only).select("user_id", "category_id"))) == {
        (7, 2), (8, None)}


def test_matrix_shows_a_category_that_is_both_own_and_system_once(spark, small):
    from tallyframe import schema as S
    cats = spark.createDataFrame([(1, "x", "OUTCOME", True, 7)], S.CATEGORY)
    assert sorted(rows(user_category_matrix(small.users(7, 8), cats).select("user_id", "category_id"))) == [(7, 1), (8, 1)]


def test_category_report_averages_and_zero_rows(small):
    cats = small.categories((11, "shopping", "OUTCOME", None), (12, "travel", "OUTCOME", None))
    t = small.transactions((1, 1, "OUTCOME", 1, "2024-01-05", 11), (2, 1, "OUTCOME", 2, "2024-01-06", 11),
                           (3, 2, "OUTCOME", 9, "2024-01-06"))
    out = by(reports.category_report(small.users(1), cats, t), "category_id")
    assert (out[11]["transaction_count"], out[11]["avg_amount"], out[11]["min_amount"], out[11]["max_amount"]) == (
        2, 1.5, money(1), money(2))
    assert (out[12]["month"], out[12]["transaction_count"], out[12]["total_amount"], out[12]["avg_amount"]) == (
        None, 0, money(0), 0.0)


def test_account_report_shows_active_accounts_and_rows_of_any_user(spark, small):
    from tallyframe.sources.ledger import currencies
    t = small.transactions((1, 1, "INCOME", 5, "2024-01-05", None, 10), (2, 2, "OUTCOME", 2, "2024-03-01", None, 10),
                           (3, 1, "INCOME", 5, "2024-01-05", None, 11))
    accounts = small.accounts((10, 1, 100, True, 103), (11, 1, 0, False), (12, 1, 7))
    out = by(reports.account_balance_report(accounts, small.users(1), currencies(spark), t), "account_id")
    assert set(out) == {10, 12}
    assert (out[10]["total_income"], out[10]["total_expense"], out[10]["transaction_count"]) == (money(5), money(2), 2)
    assert (out[10]["first_transaction_date"], out[10]["last_transaction_date"]) == (day("2024-01-05"), day("2024-03-01"))
    assert (out[12]["transaction_count"], out[12]["first_transaction_date"], out[12]["currency"]) == (0, None, None)


@pytest.fixture(scope="module")
def spending(small):
    return small.transactions(
        (1, 1, "OUTCOME", 10, "2024-01-10", 11), (2, 1, "OUTCOME", 20, "2024-02-20", 11),
        (3, 1, "OUTCOME", 99, "2024-01-09", 11), (4, 1, "OUTCOME", 99, "2024-02-21", 11),
        (5, 1, "INCOME", 7, "2024-02-01", 1), (6, 2, "OUTCOME", 5, "2024-02-01", 11), (7, None, "OUTCOME", 5, "2024-02-01", 11),
    )


def test_budget_execution_counts_both_end_days_and_guards_limits(small, spending):
    b = small.budgets((1, 1, "2024-01-10", "2024-02-20", 30), (2, 1, "2024-01-10", "2024-02-20", None),
                      (3, 1, "2024-01-10", "2024-02-20", 0), (4, 1, "2024-01-10", "2024-02-20", 0.01),
                      (5, 3, "2024-01-10", "2024-02-20", 8), (6, 1, "2024-01-10", "2024-02-20", 8, False))
    out = by(reports.budget_execution(b, small.users(1, 2, 3), spending), "budget_id")
    assert set(out) == {1, 2, 3, 4, 5}
    assert (out[1]["actual_expense"], out[1]["actual_income"], out[1]["expense_remaining"]) == (money(30), money(7), money(0))
    assert [out[i]["expense_percentage_used"] for i in (1, 2, 3, 4, 5)] == [100.0, None, None, 300000.0, 0.0]
    assert out[2]["expense_remaining"] is None


def test_budget_progress_unrounded_with_zero_defaults(small, spending):
    b = small.budgets((1, 1, "2024-01-10", "2024-02-20", 90, False), (2, 1, "2024-01-10", "2024-02-20", None),
                      (3, 1, "2024-01-10", "2024-02-20", 0))
    out = by(reports.budget_progress(b, spending), "budget_id")
    assert out[1]["percentage"] == 30.0 / 90.0 * 100.0
    assert [out[i]["remaining"] for i in (1, 2, 3)] == [money(60), money(0), money(0)]
    assert [out[i]["percentage"] for i in (2, 3)] == [0.0, 0.0]


def test_limit_check_exceeded_is_strict_and_zero_limit_sorts_first(small, spending):
    b = small.budgets((1, 1, "2024-01-10", "2024-02-20", None))
    cats = small.categories((1, "salary", "INCOME", None), (11, "shopping", "OUTCOME", None), (12, "travel", "OUTCOME", None))
    l = small.limits((1, 1, 11, 30), (2, 1, 12, 0), (3, 1, 1, 5))
    out = rows(reports.budget_limit_check(l, b, cats, spending).select(
        "category_id", "spent_amount", "percentage_used", "is_exceeded"))
    assert out == [(12, money(0), None, False), (11, money(30), 100.0, False), (1, money(0), 0.0, False)]
    progress = by(reports.category_limit_progress(small.limits((1, 1, 11, 29.99), (2, 1, 12, 0)), b, spending), "limit_id")
    assert (progress[1]["percentage"], progress[1]["over_budget"]) == (100.0, True)
    assert (progress[2]["percentage"], progress[2]["remaining"]) == (0.0, money(0))


def test_unknown_budget_raises(small, spending):
    b = small.budgets((1, 1, "2024-01-10", "2024-02-20", None))
    cats = small.categories((11, "shopping", "OUTCOME", None))
    one = reports.budget_limit_check(small.limits((1, 1, 11, 30)), b, cats, spending, budget_id=1)
    assert len(one.collect()) == 1
    with pytest.raises(LookupError, match="Budget not found: 9"):
        reports.budget_limit_check(small.limits((1, 1, 11, 30)), b, cats, spending, budget_id=9).collect()


def test_current_budget_newest_start_then_highest_id(small):
    b = small.budgets((1, 1, "2024-01-01", "2024-12-31", 1), (2, 1, "2024-03-01", "2024-03-31", 1),
                      (3, 1, "2024-03-01", "2024-03-31", 1), (4, 1, "2024-03-20", "2024-03-31", 1, False),
                      (5, 2, "2024-01-01", "2024-02-14", 1), (6, 2, "2024-01-01", "2024-02-13", 1),
                      (7, 3, "2024-03-16", "2024-04-01", 1))
    out = {u: i for u, i in rows(dashboard.current_budget(b, day("2024-03-15")).select("user_id", "id"))}
    assert out == {1: 3, 2: 5}


def test_dashboard_window_is_31_days_and_users_without_data_stay(small):
    t = small.transactions((1, 1, "INCOME", 5, "2024-03-15", None, 10), (2, 1, "OUTCOME", 2, "2024-02-14"),
                           (3, 1, "OUTCOME", 9, "2024-02-13"), (4, 1, "OUTCOME", 9, "2024-03-16"))
    accounts = small.accounts((10, 1, 0, True, 5), (11, 1, 50, False))
    b = small.budgets((1, 1, "2024-02-13", "2024-03-16", 10))
    out = by(dashboard.dashboard_summary(small.users(1, 2), b, t, accounts, day("2024-03-15")), "user_id")
    assert (out[1]["total_income"], out[1]["total_expense"], out[1]["balance"]) == (money(5), money(2), money(5))
    assert (out[1]["budget_spent"], out[1]["budget_percentage"]) == (money(20), 200.0)
    assert (out[2]["total_income"], out[2]["balance"], out[2]["budget_id"]) == (money(0), money(0), None)


def test_counts_and_details(small):
    t = small.transactions((1, 1, "INCOME", 5, "2024-03-15", None, 10), (2, 1, "OUTCOME", 7, "2024-02-14", None, 10))
    a = small.accounts((10, 1, 0), (11, 1, 0))
    assert set(rows(reports.account_transaction_counts(a, t).select("account_id", "transaction_count"))) == {(10, 2), (11, 0)}
    assert by(reports.account_detail_totals(a, t), "account_id")[10]["net_change"] == money(-2)
    assert by(balances.total_active_balance(small.users(1, 2), a), "user_id")[2]["total_balance"] == money(0)
