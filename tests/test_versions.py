"""New ids, versioned commits, the run log of the recurring job, creations and refusals."""

import datetime as dt
import re

import pytest
from ledger_rows import by, day, money, rows
from pyspark.sql import functions as F

from tallyframe.operators import creation, filters, mutations
from tallyframe.operators import recurring as R
from tallyframe.plans.ids import largest_id, with_new_ids
from tallyframe.plans.prefix import prefix_totals
from tallyframe.sources import versions
from tallyframe.streaming import nightly

NOW = dt.datetime(2024, 2, 1)


# --- ids ----------------------------------------------------------------

@pytest.mark.parametrize("parts", [1, 7])
def test_ids_are_dense_and_in_order(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("request_id"), F.lit("x").alias("id")).repartition(parts)
    out = with_new_ids(df, ["request_id"], above=50)
    got = rows(out.select("request_id", "id"))
    assert sorted(got) == [(k, 51 + k) for k in range(1000)]
    assert sorted(rows(out.select("request_id", "id"))) == sorted(got)  # the same at every reading
    assert with_new_ids(df.filter("false"), ["request_id"], 9).count() == 0
    assert largest_id(spark.createDataFrame([], "id long")) == 0


def test_no_task_numbers_more_than_its_part(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("request_id"), F.lit(1).alias("user_id"))
    plan = with_new_ids(df, ["request_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


# --- versions -----------------------------------------------------------

@pytest.fixture
def store(spark, small, tmp_path):
    root = str(tmp_path / "store")
    t = small.transactions((1, 1, "OUTCOME", 5, "2024-01-30", 11, 10), (2, 1, "INCOME", 9, "2024-02-03", 1, 10))
    tables = {
        "transactions": t, "categories": small.categories((11, "shopping", "OUTCOME", None), (1, "salary", "INCOME", None)),
        "accounts": small.accounts((10, 1, 100)),
        "recurring": small.recurring((1, 1, 10, 5, "OUTCOME", 11, "a", "daily", "2024-01-01"), (2, 1, 10, 7, "OUTCOME", 11, "b", "weekly", "2024-01-01")),
    }
    assert versions.commit(spark, root, replace=tables) == 1
    return root


def test_commits_show_whole_or_not_at_all(spark, small, store, monkeypatch):
    before = versions.read(spark, store)
    more = small.transactions((3, 1, "OUTCOME", 2, "2024-03-01"))
    write = versions._write

    def dying(name, df, path):
        if name == "accounts":
            raise OSError("disk gone")
        write(name, df, path)

    monkeypatch.setattr(versions, "_write", dying)
    with pytest.raises(OSError, match="disk gone"):
        versions.commit(spark, store, replace={"categories": before["categories"].filter("false"), "accounts": before["accounts"]}, append={"transactions": more})
    monkeypatch.undo()
    assert versions.newest(spark, store) == 1
    now = versions.read(spark, store)
    assert (now["categories"].count(), now["transactions"].count()) == (2, 2)
    assert versions.commit(spark, store, append={"transactions": more}) == 2
    assert sorted(r[0] for r in rows(versions.read(spark, store)["transactions"].select("id"))) == [1, 2, 3]
    assert versions.read(spark, store, 1)["transactions"].count() == 2
    assert versions.read(spark, store)["budgets"].count() == 0


def test_a_run_id_commits_once_and_a_stale_base_conflicts(spark, small, store):
    more = small.transactions((3, 1, "OUTCOME", 2, "2024-03-01"))
    first = versions.commit(spark, store, append={"transactions": more}, run_id="load")
    assert versions.commit(spark, store, append={"transactions": more}, run_id="load") == first == 2
    assert versions.read(spark, store)["transactions"].count() == 3
    with pytest.raises(versions.Conflict):
        versions.commit(spark, store, append={"transactions": more}, base=1)


def test_two_writers_from_one_version(spark, small, store, monkeypatch):
    monkeypatch.setattr(versions, "newest", lambda *_: 0)
    with pytest.raises(versions.Conflict, match="another writer"):
        versions.commit(spark, store, append={"transactions": small.transactions((3, 1, "OUTCOME", 2, "2024-03-01"))})


def test_date_filters_skip_folders_after_a_change(spark, small, store):
    versions.commit(spark, store, append={"transactions": small.transactions((3, 1, "OUTCOME", 2, "2024-03-01"))})
    got = filters.filter_by_date_range(versions.read(spark, store)["transactions"], day("2024-02-10"), day("2024-03-31"))
    assert [r["id"] for r in got.collect()] == [3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "2024-02-01" in re.search(r"PartitionFilters: \[(.*?month.*?)\]", plan).group(1)
    assert "commit=" not in str(got.columns)


def test_an_empty_store(spark, tmp_path):
    assert versions.newest(spark, str(tmp_path / "none")) == 0
    assert versions.read(spark, str(tmp_path / "none"))["transactions"].count() == 0
    assert versions.commit(spark, str(tmp_path / "none")) == 1


# --- the recurring job ---------------------------------------------------

def test_overlap_after_an_append_leaves_all_rows_once(spark, small, tmp_path):
    templates = small.recurring((1, 1, 10, 5, "OUTCOME", 11, "a", "daily", "2024-01-01"))
    cats = small.categories((11, "shopping", "OUTCOME", None))
    t, out = small.transactions((90, 1, "INCOME", 5, "2024-01-30", None, 10)), str(tmp_path / "log")
    first = rows(nightly.run_nightly(spark, templates, cats, t, day("2024-02-01"), day("2024-02-03"), out).select("date"))
    assert sorted(first) == [(day("2024-02-02"),), (day("2024-02-03"),)]
    appended = t.unionByName(nightly.run_nightly(spark, templates, cats, t, day("2024-02-01"), day("2024-02-03"), out).select(
        (F.dayofmonth("date") + 100).cast("long").alias("id"), *[c for c in t.columns if c != "id"]))
    second = rows(nightly.run_nightly(spark, templates, cats, appended, day("2024-02-01"), day("2024-02-04"), out).select("date"))
    assert sorted(second) == [(day(f"2024-02-0{k}"),) for k in (2, 3, 4)]
    assert nightly.run_nightly(spark, templates, cats, appended, day("2024-02-04"), day("2024-02-04"), out).count() == 0


def test_committed_runs_add_ids_balances_and_counts_once(spark, store):
    one = by(nightly.commit_nightly(spark, store, day("2024-01-28"), day("2024-01-30")), "day")
    assert {d: r["created_count"] for d, r in one.items()} == {day("2024-01-29"): 2, day("2024-01-30"): 0}
    two = nightly.commit_nightly(spark, store, day("2024-01-28"), day("2024-02-01"))
    assert sorted(r["created_count"] for r in two.collect()) == [0, 1, 1, 2]
    again = versions.newest(spark, store)
    nightly.commit_nightly(spark, store, day("2024-01-28"), day("2024-02-01"))
    assert versions.newest(spark, store) == again
    L = versions.read(spark, store)
    made = sorted(rows(L["transactions"].filter("id > 2").select("id", "date", "amount")))
    assert made == [(3, day("2024-01-29"), money(5)), (4, day("2024-01-29"), money(7)), (5, day("2024-01-31"), money(5)), (6, day("2024-02-01"), money(5))]
    assert rows(L["accounts"].select("balance")) == [(money(100 - 22),)]
    assert sorted(rows(L["recurring_log"].select("recurring_id", "id"))) == [(1, 3), (1, 5), (1, 6), (2, 4)]


def test_due_dates_equal_the_test_of_every_day(small):
    templates = small.recurring(*[
        (k, 1, None, 1, "OUTCOME", None, "x", f, s, e)
        for k, (f, s, e) in enumerate([(f, s, e) for f in ("daily", "weekly", "monthly", "yearly", "hourly")
                                       for s in ("2019-01-31", "2020-02-29", "2021-06-15", "2023-12-25") for e in (None, "2022-03-07")])])
    for a, b in (("2020-01-01", "2024-03-01"), ("2023-12-25", "2023-12-25"), ("2024-02-29", "2024-02-29"), ("2018-01-01", "2018-06-01")):
        for honor in (False, True):
            days = F.explode(F.sequence(F.lit(day(a)), F.lit(day(b)), F.expr("INTERVAL 1 DAY")))
            want = templates.withColumn("date", days).filter(R._is_due(F.col("date"), honor)).select("id", "date")
            got = R.recurring_due_range(templates, day(a), day(b), honor)
            assert got.columns == [*templates.columns, "date"]
            assert sorted(rows(got.select("id", "date"))) == sorted(rows(want))


# --- creations and refusals ----------------------------------------------

def test_created_transactions(spark, small):
    t = small.transactions((70, 1, "OUTCOME", 5, "2024-01-30"))
    accounts, cats = small.accounts((10, 1, 100), (20, 2, 0)), small.categories((11, "shopping", "OUTCOME", None))
    batch = spark.createDataFrame(
        [(9, 1, "INCOME", money(4), day("2024-01-01"), None, None, 10), (3, 1, "OUTCOME", money(1), day("2024-01-01"), "x", 11, 10),
         (4, 1, "OUTCOME", None, day("2024-01-01"), None, None, None), (5, 1, "OUTCOME", money(1), None, None, None, None),
         (6, 1, "OUTCOME", money(1), day("2024-01-01"), None, 999, None), (7, 1, "OUTCOME", money(1), day("2024-01-01"), None, None, 20),
         (8, 1, None, money(1), day("2024-01-01"), None, None, None), (2, None, "INCOME", money(8), day("2024-01-01"), None, None, None)],
        "request_id long, user_id long, type string, amount decimal(16,2), date date, description string, category_id long, account_id long")
    new, after, report = mutations.create_transactions(t, accounts, cats, batch, NOW)
    assert {r["request_id"]: (r["id"], r["reason"]) for r in report.collect()} == {
        2: (71, None), 3: (72, None), 9: (73, None), 4: (None, "amount required"), 5: (None, "date required"),
        6: (None, "category not found"), 7: (None, "account not found or access denied"), 8: (None, "invalid type")}
    assert new.columns == t.columns and sorted(rows(new.select("id", "amount"))) == [(71, money(8)), (72, money(1)), (73, money(4))]
    assert {r["id"]: r["balance"] for r in after.collect()} == {10: money(103), 20: money(0)}
    none, same, empty = mutations.create_transactions(t, accounts, cats, batch.filter("false"), NOW)
    assert none.count() == empty.count() == 0 and same.count() == 2


def test_ingest_refuses_used_ids_and_missing_values(small):
    t, accounts = small.transactions((1, 1, "OUTCOME", 5, "2024-01-30")), small.accounts((10, 1, 100))
    batch = small.transactions((1, 1, "OUTCOME", 3, "2024-01-30", None, 10), (2, 1, "OUTCOME", None, "2024-01-30"), (3, 1, "INCOME", 2, "2024-01-30", 999, 10),
                               (4, 1, "INCOME", 2, "2024-01-30", None, 10), (4, 1, "INCOME", 2, "2024-01-31", None, 10), (5, 1, "INCOME", 6, "2024-01-31", None, 10))
    out, after, report = mutations.ingest_transactions(t, accounts, batch, NOW, small.categories((11, "x", "OUTCOME", None)))
    assert sorted((r["id"], r["reason"]) for r in report.filter("reason IS NOT NULL").collect()) == [
        (1, "id already used"), (2, "amount required"), (3, "category not found"), (4, "id given more than once"), (4, "id given more than once")]
    assert sorted(r["id"] for r in out.collect()) == [1, 5] and after.first()["balance"] == money(106)


def test_limits_keep_owner_category_and_uniqueness(spark, small):
    budgets = small.budgets((1, 1, "2024-01-01", "2024-12-31", 9), (2, 2, "2024-01-01", "2024-12-31", 9))
    cats = small.categories((11, "a", "OUTCOME", None), (12, "b", "OUTCOME", None), (13, "mine", "OUTCOME", 1), (14, "theirs", "OUTCOME", 2), (1, "salary", "INCOME", None))
    limits = small.limits((1, 1, 11, 5), (2, 1, 12, 5), (3, 2, 11, 5))

    def edit(*some):
        df = spark.createDataFrame([(i, b, c, money(a), gone, u) for i, b, c, a, gone, u in some],
                                   "id long, budget_id long, category_id long, limit_amount decimal(16,2), is_deleted boolean, user_id long")
        after, report = mutations.upsert_limits(limits, budgets, cats, df)
        return sorted(rows(after.select("id", "budget_id", "category_id"))), {r["id"]: r["reason"] for r in report.collect()}

    same = [(1, 1, 11), (2, 1, 12), (3, 2, 11)]
    for change, why in (((3, 1, 11, 6, False, 1), "limit of another budget"), ((3, 2, 11, 6, False, 1), "budget not found"), ((9, 77, 11, 6, False, 1), "budget not found"),
                        ((9, 1, 1, 6, False, 1), "category not allowed"), ((9, 1, 14, 6, False, 1), "category not allowed"), ((9, 1, 999, 6, False, 1), "category not allowed"),
                        ((9, 1, 11, 6, False, 1), "category already has a limit"), ((1, 1, 12, 6, False, 1), "category already has a limit"),
                        ((9, 1, 13, None, False, 1), "amount required"), ((9, 1, 13, 6, True, 1), "not found")):
        assert edit(change) == (same, {change[0]: why}), change
    assert edit((9, 1, 13, 6, False, 1), (8, 1, 13, 6, False, 1)) == ([*same, (8, 1, 13)][:3] + [(8, 1, 13)], {8: None, 9: "category already has a limit"})
    assert edit((2, 1, 12, 6, True, 1), (1, 1, 12, 6, False, 1)) == ([(1, 1, 12), (3, 2, 11)], {1: None, 2: None})
    assert edit((1, 1, 11, 6, False, 1), (1, 1, 11, 7, False, 1))[1] == {1: "edited more than once"}


def test_own_categories_are_unique_and_never_system(spark, small):
    cats = small.categories((5, "pets", "OUTCOME", 1), (7, "food", "OUTCOME", None))
    batch = spark.createDataFrame([(1, 1, "pets", "INCOME", True), (2, 2, "pets", "INCOME", True), (3, 2, " pets", "OUTCOME", False), (4, 1, "food", "OUTCOME", False),
                                   (5, 1, None, "OUTCOME", False), (6, 1, "x" * 51, "OUTCOME", False), (7, 1, "y", None, False), (8, None, "z", "OUTCOME", False)],
                                  "request_id long, user_id long, name string, type string, is_system boolean")
    new, report = creation.create_categories(cats, batch)
    assert sorted(rows(new)) == [(8, "pets", "INCOME", False, 2), (9, "food", "OUTCOME", False, 1)]
    assert {r["request_id"]: r["reason"] for r in report.collect()} == {
        1: "name already used", 2: None, 3: "name already used", 4: None, 5: "name required", 6: "name too long", 7: "invalid type", 8: "user required"}


def test_templates_need_an_own_active_account(spark, small):
    accounts = small.accounts((10, 1, 0), (11, 1, 0, False), (20, 2, 0))
    cats = small.categories((11, "a", "OUTCOME", None), (14, "theirs", "OUTCOME", 2))
    old = small.recurring((3, 1, 10, 1, "OUTCOME", None, "x", "daily", "2024-01-01"))
    batch = old.drop("id").withColumn("request_id", F.lit(1).cast("long"))
    changes = {2: ("account_id", F.lit(11)), 3: ("account_id", F.lit(20)), 4: ("account_id", F.lit(None)), 5: ("category_id", F.lit(14)), 6: ("frequency", F.lit("hourly")),
               7: ("type", F.lit("X")), 8: ("amount", F.lit(None)), 9: ("start_date", F.lit(None)), 10: ("category_id", F.lit(11))}
    for k, (c, v) in changes.items():
        batch = batch.unionByName(old.drop("id").withColumn("request_id", F.lit(k).cast("long")).withColumn(c, v.cast(old.schema[c].dataType)))
    new, report = creation.create_recurring(old, accounts, cats, batch)
    assert sorted(rows(new.select("id", "category_id"))) == [(4, None), (5, 11)]
    access = "account not found or access denied"
    assert {r["request_id"]: r["reason"] for r in report.collect()} == {
        1: None, 2: access, 3: access, 4: access, 5: "category not allowed", 6: "invalid frequency", 7: "invalid type", 8: "amount required",
        9: "start date required", 10: None}


# --- prefix sums ----------------------------------------------------------

def test_prefix_sums_equal_the_row_level_sums(spark, small):
    facts = [(k, 1 if k % 3 else k % 7, "OUTCOME", k % 13 + 1, str(day("2023-01-01") + dt.timedelta(k * 37 % 500))) for k in range(900)]
    spans = [(k, k % 8, str(day("2022-12-20") + dt.timedelta(k * 11 % 500)), str(day("2022-12-20") + dt.timedelta((k * 11 % 500) + (k * 5 % 90) - 3)), None) for k in range(120)]
    spans += [(200, 1, "2023-01-01", "2023-01-01", None), (201, 1, "2023-01-01", "2023-01-01", None), (202, 1, "2010-01-01", "2030-01-01", None)]
    got = prefix_totals(small.budgets(*spans), "start_date", "end_date", small.transactions(*facts), ["user_id"], {"spent": F.col("amount")})
    want = {i: money(sum(a for _, fu, _, a, d in facts if fu == u and s <= d <= e)) for i, u, s, e, _ in spans}
    assert {r["id"]: r["spent"] for r in got.collect()} == want
    assert prefix_totals(small.budgets(*spans).filter("false"), "start_date", "end_date", small.transactions(*facts), ["user_id"], {"spent": F.col("amount")}).count() == 0
