"""Sides that grow with the ledger are shuffled, however small the optimizer takes them to be."""

import re

import pytest
from ledger_rows import rows

from tallyframe.functions import sql
from tallyframe.operators import mutations, reports


@pytest.fixture
def tables(spark):
    """Ten budgets with two limits each, exploded from ten ids that would be broadcast."""
    budgets = spark.range(10).selectExpr(
        "id", "'b' AS name", "'YEARLY' AS period_type", "DATE '2024-01-01' AS start_date", "DATE '2024-12-31' AS end_date",
        "CAST(9 AS DECIMAL(16,2)) AS total_expense_limit", "true AS is_active", "id % 2 AS user_id")
    limits = spark.range(10).selectExpr("id AS budget_id", "explode(array(11L, 12L)) AS category_id").selectExpr(
        "budget_id * 100 + category_id AS id", "budget_id", "category_id", "CAST(5 AS DECIMAL(16,2)) AS limit_amount")
    categories = spark.range(11, 13).selectExpr("id", "concat('c', id) AS name", "'OUTCOME' AS type", "true AS is_system", "CAST(NULL AS BIGINT) AS user_id")
    transactions = spark.range(20).selectExpr(
        "id", "id % 2 AS user_id", "'OUTCOME' AS type", "CAST(1 AS DECIMAL(16,2)) AS amount", "date_add(DATE '2024-05-05', CAST(id % 3 AS INT)) AS date",
        "'x' AS description", "11 + id div 20 AS category_id", "CAST(NULL AS BIGINT) AS account_id")
    accounts = spark.range(2).selectExpr("id", "CAST(0 AS DECIMAL(16,2)) AS initial_balance")
    return {"budgets": budgets, "limits": limits, "categories": categories, "transactions": transactions, "accounts": accounts}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_limit_edits_broadcast_no_table(tables):
    edits = tables["limits"].selectExpr("id", "budget_id", "category_id", "limit_amount", "category_id = 12 AS is_deleted")
    after, report = mutations.upsert_limits(tables["limits"], tables["budgets"], None, edits)
    assert "BroadcastHashJoin" not in plan(after) and "BroadcastHashJoin" not in plan(report)
    assert after.count() == 10 and report.filter("status = 'ok'").count() == 20


def test_budget_edits_broadcast_no_table(tables):
    b = tables["budgets"].drop("is_active")
    edits = b.filter("id < 5").withColumn("end_date", b["start_date"])  # all refused
    limit_edits = tables["limits"].selectExpr("id", "budget_id", "category_id", "limit_amount", "true AS is_deleted")
    found = mutations.upsert_budgets(tables["budgets"], tables["limits"], edits, limit_edits)
    for df in found:
        assert "BroadcastHashJoin" not in plan(df)
    assert [df.count() for df in found] == [10, 10, 5]


def test_sql_limit_check_shuffles_budgets_and_limits(spark, tables):
    sql.register(spark, tables, "growing")
    got = spark.sql("SELECT c.* FROM growing_budgets b, LATERAL growing_limit_check(b.id) c")
    assert re.search(r"SortMergeJoin \[budget_id#\d+L\], \[id#\d+L\], Inner", plan(got))
    assert got.count() == 20


def test_limit_totals_use_all_partitions_and_broadcast_nothing(spark, tables):
    found = reports.limit_totals(tables["limits"], tables["budgets"], tables["transactions"])
    assert "BroadcastHashJoin" not in plan(found)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert {r["category_id"]: int(r["spent"]) for r in found.collect()} == {11: 10, 12: 0}
    assert len(rows(found)) == 20


def test_limit_edits_are_dealt_once_by_budget_id_and_place(tables):
    """Edits twice, budgets and limits twice by id, the places: before, each of three readers dealt all edits anew."""
    edits = tables["limits"].selectExpr("id", "budget_id", "23 - category_id AS category_id", "limit_amount", "false AS is_deleted")
    extra = edits.filter("id = 11").unionByName(edits.filter("id = 111").selectExpr("9000L AS id", "budget_id", "CAST(NULL AS BIGINT) AS category_id", "limit_amount", "is_deleted"))
    after, report = mutations.upsert_limits(tables["limits"], tables["budgets"], None, edits.unionByName(extra))
    assert 0 < plan(after).count("Exchange hashpartitioning") <= 6
    found = {r["id"]: (r["budget_id"], r["category_id"]) for r in after.collect()}
    assert found == {b * 100 + c: (b, c) for b in range(10) for c in (11, 12)} | {9000: (None, None)}
    reasons = [(r["id"], r["reason"]) for r in report.collect()]
    assert sorted(i for i, why in reasons if why == "edited more than once") == [11, 11]
    assert sum(why == "category already has a limit" for _, why in reasons) == 19 and len(reasons) == 22
