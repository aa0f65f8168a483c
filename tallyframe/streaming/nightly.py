"""The nightly recurring job, run for every day since the last run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import schema as S
from tallyframe.operators.filters import filter_by_date_range
from tallyframe.operators.recurring import apply_to_balances, materialize_recurring
from tallyframe.plans.ids import largest_id, with_new_ids
from tallyframe.schema import RECURRING_SUFFIX
from tallyframe.session import written
from tallyframe.sources import versions
from tallyframe.sources.literals import literal_rows


def recurring_nightly(
    recurring: DataFrame,
    categories: DataFrame,
    transactions: DataFrame,
    last_run: dt.date,
    as_of: dt.date,
    suffix: str = RECURRING_SUFFIX,
) -> DataFrame:
    """Rows to create for the days after ``last_run`` up to ``as_of``.

    Days do not influence each other, since an equal row only counts on its
    own day, so a missed week is one job.
    """
    return materialize_recurring(
        recurring, categories, transactions, last_run + dt.timedelta(days=1), as_of, suffix
    )


def _open_days(log: DataFrame, last_run: dt.date, as_of: dt.date) -> list[dt.date]:
    """Days after ``last_run`` up to ``as_of`` that no earlier run has done; the driver sees days only."""
    done = {r["day"] for r in log.filter(F.col("day").between(last_run, as_of)).select("day").collect()}
    days = (last_run + dt.timedelta(days=k + 1) for k in range(max(0, (as_of - last_run).days)))
    return [d for d in days if d not in done]


def _of_days(made: DataFrame, days: list[dt.date]) -> DataFrame:
    return made.filter(F.col("date").isin(days))


def _counts(spark: SparkSession, made: DataFrame, days: list[dt.date]) -> DataFrame:
    """(day, created_count) of every day, days without rows included."""
    kind = T.StructType([S.RECURRING_DAY["day"]])
    every = literal_rows(spark, [(d.isoformat(),) for d in days], kind)
    count = made.groupBy(F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(count, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("created_count"))


def run_nightly(
    spark: SparkSession,
    recurring: DataFrame,
    categories: DataFrame,
    transactions: DataFrame,
    last_run: dt.date,
    as_of: dt.date,
    out: str,
) -> DataFrame:
    """Rows of the days after ``last_run`` up to ``as_of``, each day computed once and logged below ``out``.

    A day an earlier run has logged is returned as it was logged, whether its
    rows have reached ``transactions`` since or not; so runs may repeat or
    overlap. ``out`` is a version store of its own: a run that dies logs nothing.
    """
    base = versions.newest(spark, out)
    days = _open_days(versions.read(spark, out, base)["recurring_days"], last_run, as_of)
    if days:
        made = recurring_nightly(recurring, categories, transactions, days[0] - dt.timedelta(days=1), days[-1])
        made = written(_of_days(made, days).withColumn("id", F.lit(None).cast("long")), "nightly")
        versions.commit(spark, out, append={"recurring_log": made, "recurring_days": _counts(spark, made, days)}, base=base)
    log = versions.read(spark, out)["recurring_log"]
    rows = filter_by_date_range(log, last_run + dt.timedelta(days=1), as_of) if as_of > last_run else log.filter("false")
    return rows.drop("id", "month")


def commit_nightly(spark: SparkSession, root: str, last_run: dt.date, as_of: dt.date, suffix: str = RECURRING_SUFFIX) -> DataFrame:
    """Run the job on a version store: rows with new ids, account balances, log and days in one commit.

    Days done before are left out, so runs may repeat or overlap, and a run
    that dies has done nothing. Returns (day, created_count) of the days asked for.
    """
    base = versions.newest(spark, root)
    L = versions.read(spark, root, base)
    days = _open_days(L["recurring_days"], last_run, as_of)
    if days:
        made = recurring_nightly(
            L["recurring"], L["categories"], L["transactions"], days[0] - dt.timedelta(days=1), days[-1], suffix)
        made = with_new_ids(_of_days(made, days), ["date", "recurring_id"], largest_id(L["transactions"]))
        versions.commit(
            spark, root, base=base, replace={"accounts": apply_to_balances(L["accounts"], made)},
            append={"transactions": made, "recurring_log": made, "recurring_days": _counts(spark, made, days)})
    done = versions.read(spark, root)["recurring_days"]
    return done.filter((F.col("day") > last_run) & (F.col("day") <= as_of))
