import datetime as dt

from ledger_rows import by, day, rows
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.sources import seeds, sinks
from tallyframe.sources.generate import generate_transactions


def test_seeding_is_idempotent(spark, small):
    start = small.categories((7, "salary", "INCOME", None), (9, "travel", "OUTCOME", 3))
    once = seeds.seed_categories(spark, start)
    assert once.filter("is_system").count() == 21 and once.count() == 22
    assert once.select("id").distinct().count() == 22
    assert seeds.seed_categories(spark, once).count() == 22
    empty = spark.createDataFrame([], S.CURRENCY)
    assert seeds.seed_currencies(spark, empty).count() == 20
    one = spark.createDataFrame([(5, "Euro", "EUR")], S.CURRENCY)
    assert seeds.seed_currencies(spark, one).count() == 1
    assert seeds.seed_currencies(spark, one, by_name=True).count() == 20


def test_reset_replaces_ownerless_system_rows_only(spark, small):
    start = small.categories((7, "salary", "INCOME", None), (9, "travel", "OUTCOME", 3))
    after = seeds.reset_system_categories(spark, start)
    assert after.count() == 27 and after.filter("id = 9").count() == 1 and after.filter("name = 'salary'").count() == 0
    assert seeds.reset_system_categories(spark, start, [("a", "INCOME")]).count() == 2


def test_generator_keeps_its_rules(spark, small):
    users = small.users(1, 2, 3, 4)
    accounts = small.accounts((10, 1, 0), (11, 1, 0), (12, 1, 0, False), (20, 2, 0), (30, 3, 0, False), (40, 4, 0))
    cats = small.categories((1, "salary", "INCOME", None), (11, "shopping", "OUTCOME", None), (31, "own", "OUTCOME", 1), (32, "own", "OUTCOME", 2))
    made = generate_transactions(users, accounts, cats, 400, day("2024-03-01")).cache()
    got = made.collect()
    assert len(got) == 1200 and {r.user_id for r in got} == {1, 2, 4}
    assert {r.account_id for r in got if r.user_id == 1} == {10, 11}
    assert {r.category_id for r in got if r.user_id == 1} == {1, 11, 31} and {r.category_id for r in got if r.user_id == 4} == {1, 11}
    types = {1: "INCOME", 11: "OUTCOME", 31: "OUTCOME", 32: "OUTCOME"}
    for r in got:
        assert types[r.category_id] == r.type
        lo, hi = (100, 5000) if r.type == "INCOME" else (10, 500)
        assert lo <= r.amount <= hi and day("2024-01-01") <= r.date <= day("2024-03-01")
        assert r.description in (S.INCOME_DESCRIPTIONS if r.type == "INCOME" else S.OUTCOME_DESCRIPTIONS)
    assert {r.date for r in got} == {day("2024-01-01") + dt.timedelta(n) for n in range(61)}
    share = sum(r.type == "OUTCOME" for r in got) / len(got)
    assert 0.65 < share < 0.75
    again = generate_transactions(users.repartition(3), accounts, cats, 400, day("2024-03-01"))
    assert again.exceptAll(made).count() == 0
    no_income = generate_transactions(users, accounts, cats.filter("type = 'OUTCOME'"), 50, day("2024-03-01"))
    assert {r.type for r in no_income.collect()} == {"OUTCOME"}


def test_append_and_export(spark, small, tmp_path):
    t = small.transactions((1, 1, "OUTCOME", 5, "2024-01-01", 11, 10, 'say "hi"'), (2, 1, "OUTCOME", 5, "2024-02-01"))
    path = str(tmp_path / "facts")
    sinks.append_transactions(t, path)
    sinks.append_transactions(t.withColumn("id", F.col("id") + 10), path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.filter("month = DATE '2024-01-01'").count() == 2
    shown = by(sinks.export_transactions_json(t), "id")
    assert shown[1]["json"] == '{"id":1,"type":"OUTCOME","amount":"5.00","date":"2024-01-01","description":"say \\"hi\\"","category":11}'
    assert shown[2]["json"].endswith('"description":null,"category":null}')
    sinks.write_json(sinks.export_transactions_json(t), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    cats = small.categories((2, "b", "OUTCOME", 1), (1, "a", "INCOME", None))
    assert rows(sinks.export_categories_json(cats))[0] == (1, '{"id":1,"name":"a","type":"INCOME","is_system":true}')


def test_snapshots_chain_changes(spark, small, tmp_path):
    import pytest

    from tallyframe.operators import balances, mutations
    from tallyframe.sources import ledger

    L = ledger.load(spark, "/root/testdata/sf0.001")
    first, second = str(tmp_path / "v1"), str(tmp_path / "v2")
    sinks.write_snapshot(L.replaced(accounts=balances.stored_accounts(L["accounts"], L["transactions"])), first)
    stored = ledger.open_ledger(spark, first)
    assert {n: stored[n].count() for n in stored} == {n: L[n].count() for n in L}
    out, _ = mutations.delete_users_cascade(stored, stored["users"].filter("currency_id IS NULL").select("id"))
    sinks.write_snapshot(out, second)
    after = ledger.open_ledger(spark, second)
    assert after["users"].filter("currency_id IS NULL").count() == 0
    assert balances.balance_reconciliation(after["accounts"], after["transactions"]).filter("NOT is_consistent").count() == 0
    with pytest.raises(Exception, match="already exists"):
        sinks.write_snapshot(out, second)


def test_jdbc_reader_options():
    """Which options reach the JDBC source; no database is opened."""
    from tallyframe.sources import ledger

    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def option(self, key, value):
            self.seen[key] = value
            return self

        def load(self):
            return self.seen

    class Session:
        @property
        def read(self):
            return Reader()

    L = ledger.open_ledger(Session(), "jdbc:x", tables={"transactions": "t", "users": "u"},
                           partitions={"transactions": ("id", 0, 1000, 8)}, properties={"fetchsize": "10000"})
    assert L["users"] == {"format": "jdbc", "url": "jdbc:x", "dbtable": "u", "fetchsize": "10000"}
    assert L["transactions"]["numPartitions"] == 8 and L["transactions"]["partitionColumn"] == "id"
