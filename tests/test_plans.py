"""The shapes plans must keep at scale."""

import os
import re

import pytest
from ledger_rows import day, rows

from tallyframe.operators import filters, sorting
from tallyframe.plans.keys import category_lookup, position_in_group
from tallyframe.queries import QUERIES
from tallyframe.sources import ledger

ROOT = "/root/testdata/sf0.001"
RUNNING = {"stream_ingest_balances", "stream_daily_stats", "stream_account_history", "append_transactions", "append_transactions_once", "versioned_changes"}
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")


@pytest.fixture
def shuffled(spark):
    """Large tables: nothing is small enough to broadcast."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNNING))
def test_no_cross_join_no_python_no_forced_broadcast(spark, shuffled, name):
    text = plan(QUERIES[name](spark, ROOT))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "Python", "ArrowEval", "MapInPandas"):
        assert node not in text, node


def test_dates_and_columns_reach_the_scan(spark):
    t = ledger.load(spark, ROOT)["transactions"]
    text = plan(filters.filter_by_date_range(t, day("1997-01-01"), day("1997-12-31")).select("amount"))
    assert re.search(r"FileScan parquet \[o_totalprice#\d+,o_orderdate#\d+\]", text)
    assert re.search(r"DataFilters: \[isnotnull\(o_orderdate#\d+\), \(o_orderdate#\d+ >= 1997-01-01", text)


def test_month_folders_are_skipped(spark, tmp_path):
    from tallyframe.operators.recurring import recurring_antijoin, recurring_due
    from tallyframe.sources import sinks
    L = ledger.load(spark, ROOT)
    sinks.append_transactions(L["transactions"], str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    got = filters.filter_by_date_range(facts, day("1997-02-10"), day("1997-03-05"))
    assert got.count() == filters.filter_by_date_range(L["transactions"], day("1997-02-10"), day("1997-03-05")).count()
    pruned = re.search(r"PartitionFilters: \[(.*?)\]", plan(got)).group(1)
    assert "month" in pruned and "1997-02-01" in pruned and "1997-03-01" in pruned
    due = recurring_due(L["recurring"], day("1998-06-01"))
    assert "1998-06-01" in re.search(r"PartitionFilters: \[(.*?month.*?)\]", plan(
        recurring_antijoin(due, facts, day("1998-06-01"), day("1998-06-01")))).group(1)


def test_shared_folder_comes_from_the_session():
    from types import SimpleNamespace

    from tallyframe.session import shared_dir

    def session(root, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: {"spark.checkpoint.dir": root}.get(k) or d),
                               sparkContext=SimpleNamespace(master=master))

    cluster = session("hdfs://shared/ckpt/", "yarn")
    one, two = shared_dir(cluster, "x"), shared_dir(cluster, "x")
    assert one.startswith("hdfs://shared/ckpt/x-") and one != two
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(None, "yarn"), "x")


def test_early_pages_are_cut_before_the_shuffle(spark):
    t = ledger.load(spark, ROOT)["transactions"]
    text = plan(sorting.transaction_page(t, 2, 50))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert "TakeOrderedAndProject" in plan(sorting.recent_transactions(t))


def test_facts_are_summed_before_they_are_joined(spark, shuffled):
    for name in ("monthly_income_expense", "account_balance_report", "recompute_balances", "running_balance"):
        text = plan(QUERIES[name](spark, ROOT))
        scan = text.index("orders.parquet")
        above = text[:scan]
        # Reading upwards from the fact scan, an aggregate comes before any join.
        assert above.rindex("HashAggregate") > above.rindex("Join"), name


def test_category_lookup_matches_a_plain_join_when_shuffled(spark, shuffled):
    L = ledger.load(spark, ROOT)
    got = category_lookup(L["transactions"], L["categories"], "id").select("id", "category_id", "category_name", "category_owner_id")
    c = L["categories"].selectExpr("id AS category_id", "name", "user_id AS owner")
    want = L["transactions"].join(c, "category_id", "left").select("id", "category_id", "name", "owner")
    assert sorted(rows(got), key=str) == sorted(rows(want), key=str)


def test_hot_system_categories_spread_over_slots(spark, shuffled):
    """One category on every row still reaches many tasks."""
    from pyspark.sql import functions as F
    L = ledger.load(spark, ROOT)
    hot = spark.range(20_000).withColumn("category_id", F.lit(11).cast("long"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = category_lookup(hot, L["categories"], "id")
        sizes = [r[1] for r in rows(out.groupBy(F.spark_partition_id()).count())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 20_000 and len(sizes) > 8 and max(sizes) < 20_000 / 4


def test_aqe_splits_a_user_with_a_third_of_the_rows(spark, shuffled):
    """The raw-row joins keep the shape AQE's skew handling needs."""
    from pyspark.sql import functions as F

    from tallyframe.plans.keys import left_lookup
    rows_ = spark.range(600_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000 + 2).cast("long").alias("user_id"),
        F.lit(day("2024-01-15")).alias("date"),
        F.sha2(F.col("id").cast("string"), 256).alias("description"),
    )
    budgets = spark.range(1, 5002).select(
        "id", F.col("id").alias("user_id"), F.lit(day("2024-01-01")).alias("start_date"), F.lit(day("2024-01-31")).alias("end_date")
    )
    small_sizes = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    for k, v in small_sizes.items():
        spark.conf.set(k, v)
    try:
        dim = budgets.select(F.col("id").alias("_uid"), "start_date")
        for df in (filters.budget_matches(budgets, rows_), left_lookup(rows_, dim, "user_id", "id", "_uid")):
            # Reading every column keeps Catalyst from pruning the join away.
            final = df.agg(F.count(F.lit(1)), *[F.max(c) for c in df.columns])
            assert final.collect()[0][0] == 600_000
            assert "skew=true" in plan(final)
    finally:
        for k in small_sizes:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_positions_are_dense_over_blocks(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 400_000, 7).select(F.col("id"), (F.col("id") % 3).alias("g"))
    out = position_in_group(df, ["g"], "id", "pos")
    bad = out.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS want").filter("pos <> want")
    assert bad.count() == 0 and out.count() == df.count()


def test_rows_without_a_key_spread_over_tasks(spark, shuffled):
    """NULL keys of a lookup and of an anti join do not meet in one task."""
    from pyspark.sql import functions as F

    from tallyframe.plans.keys import anti_on_key, left_lookup
    facts = spark.range(20_000).withColumn("k", F.when(F.col("id") % 50 == 0, F.col("id")))
    dim = spark.range(3_000).withColumn("name", F.lit("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = left_lookup(facts, dim, "k", "id")
        for out in (found, anti_on_key(facts, dim.select("id"), "k", "id")):
            sizes = [r[1] for r in rows(out.groupBy(F.spark_partition_id()).count())]
            assert len(sizes) > 8 and max(sizes) < sum(sizes) / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found.filter("name IS NOT NULL").count() == 60
