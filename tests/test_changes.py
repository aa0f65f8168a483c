import datetime as dt
import json

import pytest
from ledger_rows import by, day, money, rows
from pyspark.sql import functions as F

from tallyframe.operators import history, mutations, quality
from tallyframe.sources.ledger import Ledger, currencies

NOW = dt.datetime(2024, 5, 1, 12)


def report(df):
    return {r.id: (r.status, r.reason) for r in df.collect()}


def test_ingest_rejects_bad_types_and_foreign_accounts(small):
    a = small.accounts((10, 1, 100), (20, 2, 0))
    batch = small.transactions(
        (1, 1, "INCOME", 5, "2024-01-01", None, 10), (2, 1, "TRANSFER", 5, "2024-01-01", None, 10),
        (3, 1, "OUTCOME", 5, "2024-01-01", None, 20), (4, 1, "OUTCOME", 5, "2024-01-01", None, 99),
        (5, 1, "OUTCOME", 5, "2024-01-01"), (6, None, "OUTCOME", 5, "2024-01-01", None, 10),
    )
    t, accounts, rep = mutations.ingest_transactions(batch.filter("false"), a, batch, NOW)
    assert sorted(r.id for r in t.collect()) == [1, 5]
    denied = ("rejected", "account not found or access denied")
    assert report(rep) == {1: ("ok", None), 2: ("rejected", "invalid type"), 3: denied, 4: denied, 5: ("ok", None), 6: denied}
    got = by(accounts, "id")
    assert got[10]["balance"] == money(105) and got[10]["updated_at"] == NOW
    assert got[20]["balance"] == money(0) and got[20]["updated_at"] == dt.datetime(2024, 1, 1)


def test_delete_recomputes_only_touched_accounts(small):
    a = small.accounts((10, 1, 100, True, 999), (11, 1, 100, True, 999))
    t = small.transactions((1, 1, "INCOME", 5, "2024-01-01", None, 10), (2, 1, "INCOME", 7, "2024-01-01", None, 10),
                           (3, 1, "INCOME", 7, "2024-01-01", None, 11))
    asked = t.sparkSession.createDataFrame([(1, 1), (3, 2), (9, 1)], "id long, user_id long")
    left, accounts, rep = mutations.delete_transactions(t, a, asked)
    assert sorted(r.id for r in left.collect()) == [2, 3]
    assert {k: r["balance"] for k, r in by(accounts, "id").items()} == {10: money(107), 11: money(999)}
    assert report(rep) == {1: ("ok", None), 3: ("rejected", "not found"), 9: ("rejected", "not found")}


def test_close_budgets(spark, small):
    b = small.budgets((1, 1, "2024-01-01", "2024-02-01", 1), (2, 1, "2024-01-01", "2024-02-01", 1, False), (3, 1, "2024-01-01", "2024-02-01", 1))
    after, rep = mutations.close_budgets(b, spark.createDataFrame([(1,), (2,), (9,), (1,)], "id long"))
    assert {r.id: r.is_active for r in after.collect()} == {1: False, 2: False, 3: True}
    assert report(rep) == {1: ("ok", None), 2: ("rejected", "already closed"), 9: ("rejected", "not found")}


@pytest.fixture(scope="module")
def ledger(spark, small):
    frames = {
        "users": small.users(1, 2),
        "categories": small.categories((1, "salary", "INCOME", None), (31, "own", "OUTCOME", 1), (32, "own", "OUTCOME", 2)),
        "accounts": small.accounts((10, 1, 0, True, 50), (20, 2, 0)),
        "transactions": small.transactions(
            (1, 1, "OUTCOME", 5, "2024-01-01", 31, 10), (2, 1, "OUTCOME", 5, "2024-01-01", None, 10), (3, 2, "OUTCOME", 5, "2024-01-01", 31, 20),
            (4, None, "OUTCOME", 5, "2024-01-01", 32), (5, 2, "INCOME", 5, "2024-01-01", 1, 20)),
        "recurring": small.recurring((1, 1, 10, 5, "OUTCOME", 31, None, "daily", "2024-01-01"), (2, 2, 20, 5, "OUTCOME", 31, None, "daily", "2024-01-01")),
        "budgets": small.budgets((1, 1, "2024-01-01", "2024-02-01", 1), (2, 2, "2024-01-01", "2024-02-01", 1)),
        "limits": small.limits((1, 1, 31, 5), (2, 2, 31, 5), (3, 2, 1, 5)),
    }
    return Ledger({k: (lambda v=v: v) for k, v in frames.items()})


def ids(df):
    return sorted(r[0] for r in rows(df.select("id")))


def test_category_cascade(spark, ledger):
    asked = spark.createDataFrame([(31, 1), (32, 1), (1, 1)], "id long, user_id long")
    out, rep = mutations.delete_categories_cascade(ledger, asked)
    assert ids(out["categories"]) == [1, 32] and ids(out["transactions"]) == [2, 4, 5] and ids(out["limits"]) == [3]
    assert [r.category_id for r in out["recurring"].collect()] == [None, None]
    assert by(out["accounts"], "id")[10]["balance"] == money(50)
    assert report(rep) == {31: ("ok", None), 32: ("rejected", "not found"), 1: ("rejected", "not found")}
    fresh, _ = mutations.delete_categories_cascade(ledger, asked, recompute=True)
    assert by(fresh["accounts"], "id")[10]["balance"] == money(-5)


def test_user_cascade_takes_rows_on_own_accounts_and_categories(spark, ledger):
    out, rep = mutations.delete_users_cascade(ledger, spark.createDataFrame([(1,), (9,)], "id long"))
    assert {k: ids(out[k]) for k in out} == {
        "users": [2], "categories": [1, 32], "accounts": [20], "transactions": [4, 5], "recurring": [2], "budgets": [2], "limits": [3]}
    assert out["recurring"].first().category_id is None
    assert report(rep) == {1: ("ok", None), 9: ("rejected", "not found")}


def test_guarded_account_delete_and_other_deletes(spark, small, ledger):
    a = small.accounts((10, 1, 0), (11, 1, 0), (20, 2, 0))
    r = small.recurring((1, 1, 11, 5, "OUTCOME", None, None, "daily", "2024-01-01"), (2, 1, None, 5, "OUTCOME", None, None, "daily", "2024-01-01"))
    asked = spark.createDataFrame([(10, 1), (11, 1), (20, 1)], "id long, user_id long")
    kept, templates, rep = mutations.delete_accounts_guarded(a, ledger["transactions"], r, asked)
    assert ids(kept) == [10, 20] and ids(templates) == [2]
    assert report(rep) == {10: ("rejected", "has 2 transactions"), 11: ("ok", None), 20: ("rejected", "not found")}
    kept, rep = mutations.delete_recurring(ledger["recurring"], spark.createDataFrame([(1, 1), (2, 1)], "id long, user_id long"))
    assert ids(kept) == [2] and report(rep)[2] == ("rejected", "not found")
    b, l, rep = mutations.delete_budgets_cascade(ledger["budgets"], ledger["limits"], spark.createDataFrame([(2, 2), (1, 2)], "id long, user_id long"))
    assert ids(b) == [1] and ids(l) == [1] and report(rep)[1] == ("rejected", "not found")


def test_accounts_open_and_edit(spark, small):
    a = small.accounts((10, 1, 0))
    batch = spark.createDataFrame(
        [(50, "new", "CASH", money(9), 1), (51, "new", "CASH", money(9), 1), (52, "acct10", "CASH", money(1), 1), (53, "acct10", "CASH", money(1), 2)],
        "id long, name string, account_type string, initial_balance decimal(16,2), user_id long")
    after, rep = mutations.open_accounts(a, batch, NOW)
    assert ids(after) == [10, 50, 53] and by(after, "id")[50]["balance"] == money(9)
    assert report(rep)[51] == report(rep)[52] == ("rejected", "name already used")
    edits = spark.createDataFrame([(50, 1, "", "WALLET"), (53, 1, "stolen", ""), (10, 1, "main", None)],
                                  "id long, user_id long, name string, account_type string")
    changed, rep = mutations.upsert_accounts(after, edits)
    got = by(changed, "id")
    assert (got[50]["name"], got[50]["account_type"], got[53]["name"], got[10]["name"]) == ("new", "WALLET", "acct10", "main")
    assert report(rep)[53] == ("rejected", "not found")


def test_budget_edits_with_limits(spark, small):
    b = small.budgets((1, 1, "2024-01-01", "2024-02-01", 5), (2, 2, "2024-01-01", "2024-02-01", 5))
    l = small.limits((1, 1, 11, 5), (2, 1, 12, 5), (3, 2, 11, 5))
    edit = "id long, user_id long, name string, period_type string, start_date date, end_date date, total_expense_limit decimal(16,2)"
    edits = spark.createDataFrame([(1, 1, "x", "CUSTOM", day("2024-01-01"), day("2024-01-09"), None), (2, 1, "y", "CUSTOM", day("2024-01-01"), day("2024-01-09"), None),
                                   (7, 2, "new", "CUSTOM", day("2024-01-01"), day("2024-01-02"), money(3)), (8, 2, "bad", "CUSTOM", day("2024-01-02"), day("2024-01-02"), None)], edit)
    limits = spark.createDataFrame([(1, 1, 11, money(6), False), (2, 1, 12, money(5), True), (3, 2, 11, money(9), False), (9, 7, 11, money(1), False), (10, 8, 11, money(1), False)],
                                   "id long, budget_id long, category_id long, limit_amount decimal(16,2), is_deleted boolean")
    after, after_limits, rep = mutations.upsert_budgets(b, l, edits, limits)
    got = by(after, "id")
    assert set(got) == {1, 2, 7} and got[1]["name"] == "x" and got[1]["total_expense_limit"] is None and got[2]["name"] == "b2"
    assert got[7]["is_active"] and got[7]["user_id"] == 2
    assert {r.id: r.limit_amount for r in after_limits.collect()} == {1: money(6), 3: money(5), 9: money(1)}
    assert report(rep)[2] == ("rejected", "not found") and report(rep)[8] == ("rejected", "end date must be after start date")


def test_currency_delete_nulls_users(spark):
    u = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "c", None)], "id long, email string, currency_id long")
    users, left, rep = mutations.currency_delete_set_null(u, currencies(spark), spark.createDataFrame([(2,), (77,)], "id long"))
    assert {r.id: r.currency_id for r in users.collect()} == {1: None, 2: 3, 3: None}
    assert left.count() == 19 and report(rep)[77] == ("rejected", "not found")


# --- quality ---------------------------------------------------------------------

def reasons(df):
    return {r.id: r.reason for r in df.collect()}


def test_unique_treats_nulls_as_distinct(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "a", None), (5, "a", None), (6, None, None)], "id long, name string, user_id long")
    assert reasons(quality.check_unique(df, ["name", "user_id"])) == {1: "duplicate key", 2: "duplicate key", 3: None, 4: None, 5: None, 6: None}
    valid, rejected = quality.split(quality.check_unique(df, ["name", "user_id"]))
    assert valid.columns == df.columns and (valid.count(), rejected.count()) == (4, 2)


def test_row_checks(spark, small):
    t = small.transactions((1, 1, "OUTCOME", 5, "2024-01-01", 11, 10, ""), (2, 1, "OUTCOME", 5, "2024-01-01", 1, 77, "x"), (3, None, "X", 5, "2024-01-01", 88))
    c = small.categories((1, "salary", "INCOME", None), (11, "shopping", "OUTCOME", None))
    assert reasons(quality.check_enums(t, ["type"])) == {1: None, 2: None, 3: "type not allowed"}
    mismatch = "category does not match type"
    assert reasons(quality.check_category_type(t, c)) == {1: None, 2: mismatch, 3: mismatch}
    refs = {"account_id": small.accounts((10, 1, 0)), "category_id": c}
    assert reasons(quality.check_references(t, refs)) == {1: None, 2: "account_id not found", 3: "category_id not found"}
    assert reasons(quality.check_required(t, ["user_id"], ["description"])) == {1: "description empty", 2: None, 3: "user_id missing"}
    wide = spark.createDataFrame([(1, "9" * 14 + ".99", "a" * 50), (2, "1" + "0" * 14, "a"), (3, "1", "a" * 51), (4, None, None)], "id long, amount string, name string")
    wide = wide.withColumn("amount", F.col("amount").cast("decimal(30,2)"))
    assert reasons(quality.check_ranges(wide, {"name": 50}, ["amount"])) == {1: None, 2: "amount out of range", 3: "name too long", 4: None}
    b = small.budgets((1, 1, "2024-01-01", "2024-01-02", 1), (2, 1, "2024-01-01", "2024-01-01", 1))
    assert reasons(quality.check_budget_dates(b)) == {1: None, 2: "end date must be after start date"}


def test_limit_categories(small):
    b = small.budgets((1, 1, "2024-01-01", "2024-01-02", 1))
    c = small.categories((1, "salary", "INCOME", None), (11, "shopping", "OUTCOME", None), (31, "own", "OUTCOME", 1), (32, "foreign", "OUTCOME", 2))
    l = small.limits((1, 1, 1, 5), (2, 1, 11, 5), (3, 1, 31, 5), (4, 1, 32, 5), (5, 1, 99, 5), (6, 9, 11, 5))
    bad = "category not allowed"
    assert reasons(quality.check_limit_categories(l, b, c)) == {1: bad, 2: None, 3: None, 4: bad, 5: bad, 6: None}


# --- history ----------------------------------------------------------------------

def test_log_replays_to_the_new_snapshot(spark, small):
    old = small.budgets((1, 1, "2024-01-01", "2024-02-01", 5), (2, 1, "2024-01-01", "2024-02-01", None), (3, 1, "2024-01-01", "2024-02-01", 5), (4, 1, "2024-01-01", "2024-02-01", 5))
    new = small.budgets((1, 1, "2024-01-01", "2024-02-01", 5), (2, 1, "2024-01-01", "2024-02-01", 7), (3, 2, "2024-01-01", "2024-02-01", None), (5, 9, "2024-01-01", "2024-02-01", 5))
    log = history.budget_history(old, new, NOW)
    got = by(log, "budget_id")
    assert {k: (r["action"], r["changed_by"]) for k, r in got.items()} == {2: ("UPDATE", 1), 3: ("UPDATE", 2), 4: ("DELETE", 1), 5: ("INSERT", 9)}
    assert json.loads(got[2]["old_data"])["total_expense_limit"] is None
    state = {r.id: json.loads(r.j) for r in old.select("id", F.to_json(F.struct(*old.columns), {"ignoreNullFields": "false"}).alias("j")).collect()}
    for k, r in got.items():
        state.pop(k, None)
        if r["new_data"]:
            state[k] = json.loads(r["new_data"])
    assert state == {r.id: json.loads(r.j) for r in new.select("id", F.to_json(F.struct(*new.columns), {"ignoreNullFields": "false"}).alias("j")).collect()}
    acted = history.account_history(small.accounts((1, 1, 0)), small.accounts((1, 1, 0), (2, 1, 0)), NOW, actor=42)
    assert [(r.account_id, r.changed_by) for r in acted.collect()] == [(2, 42)]
    assert [r.action for r in history.history_by_entity(log, "budget_id", 3).collect()] == ["UPDATE"]
