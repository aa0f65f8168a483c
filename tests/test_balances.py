import datetime as dt
import random

import pytest
from ledger_rows import by, day, money, rows

from tallyframe.operators import balances, mutations


@pytest.fixture(scope="module")
def ledger(small):
    a = small.accounts((10, 1, 100), (11, 1, 5), (12, 2, 0))
    t = small.transactions(
        (1, 1, "INCOME", 10, "2024-01-10", None, 10), (2, 1, "OUTCOME", 3, "2024-01-10", None, 10),
        (3, 1, "OUTCOME", 7, "2099-01-01", None, 10), (4, 2, "INCOME", 1, "2024-01-11", None, 12),
        (5, 2, "INCOME", 50, "2024-01-11"),
    )
    return a, t


def test_recompute_counts_future_rows_and_on_date_does_not(ledger):
    a, t = ledger
    now = by(balances.recompute_balances(a, t), "account_id")
    assert {k: v["balance"] for k, v in now.items()} == {10: money(100), 11: money(5), 12: money(1)}
    then = by(balances.balance_on_date(a, t, day("2024-01-10")), "account_id")
    assert {k: v["balance"] for k, v in then.items()} == {10: money(107), 11: money(5), 12: money(0)}


def test_running_balance_ends_at_the_recomputed_balance(ledger):
    a, t = ledger
    got = rows(balances.running_balance(a, t).orderBy("account_id", "date"))
    assert [(r[0], r[1], r[3]) for r in got] == [
        (10, day("2024-01-10"), money(107)), (10, day("2099-01-01"), money(100)), (12, day("2024-01-11"), money(1))]


def test_requests_get_the_balance_of_their_day(spark, ledger):
    a, t = ledger
    asked = spark.createDataFrame(
        [(10, day("2024-01-09")), (10, day("2024-01-10")), (10, day("2024-01-10")), (10, day("2100-01-01")),
         (11, day("2024-01-01")), (99, day("2024-01-01"))], "account_id long, date date")
    got = {(r[0], r[1]): r[2] for r in rows(balances.balance_at_requests(a, t, asked))}
    assert got == {(10, day("2024-01-09")): money(100), (10, day("2024-01-10")): money(107),
                   (10, day("2100-01-01")): money(100), (11, day("2024-01-01")): money(5), (99, day("2024-01-01")): None}


def test_single_account_raises_when_unknown(ledger):
    a, t = ledger
    assert rows(balances.account_balance(a, t, 10, day("2024-01-10")).select("balance")) == [(money(107),)]
    with pytest.raises(LookupError, match="Account not found: 77"):
        balances.account_balance(a, t, 77, day("2024-01-10"))


def test_incremental_balance_equals_recomputation(small):
    rng = random.Random(3)
    a = small.accounts(*[(i, i % 4, rng.randrange(100)) for i in range(12)])
    batch = small.transactions(*[
        (i, rng.randrange(4), rng.choice(["INCOME", "OUTCOME", "TRANSFER"]), rng.randrange(1, 50), "2024-01-01", None,
         rng.choice([None, *range(14)])) for i in range(300)])
    none = batch.filter("false")
    t, changed, report = mutations.ingest_transactions(none, a, batch, dt.datetime(2024, 5, 1))
    assert by(balances.balance_reconciliation(changed, t), "is_consistent").keys() == {True}
    assert t.count() + report.filter("status = 'rejected'").count() == 300
    # Deleting everything again brings the initial balances back.
    left, back, _ = mutations.delete_transactions(t, changed, t.select("id", "user_id"))
    assert left.count() == 0
    assert all(r["balance"] == r["initial_balance"] for r in back.collect())


def test_reconciliation_shows_drift(small, ledger):
    _, t = ledger
    stored = small.accounts((10, 1, 100, True, 90))
    row = balances.balance_reconciliation(stored, t).first()
    assert (row.stored_balance, row.recomputed_balance, row.drift, row.is_consistent) == (
        money(90), money(100), money(-10), False)
