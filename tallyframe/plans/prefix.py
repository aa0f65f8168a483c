"""Totals over date intervals from running sums.

Facts are summed to days and run up per key. A total is the running sum at an
interval's end less the one before its start, whatever the interval's length.
The two look-ups per interval are marks laid between the daily sums in one
sorted pass, so a key's pass holds at most its days with facts and its distinct
marked days, however many rows or intervals it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.schema import TOTAL


def _reach(intervals: DataFrame, start: str, end: str) -> tuple[Column, Column]:
    """First start and last end as scalar subqueries, which bound the scan of the facts."""
    return intervals.agg(F.min(start)).scalar(), intervals.agg(F.max(end)).scalar()


def prefix_totals(
    intervals: DataFrame,
    start: str,
    end: str,
    facts: DataFrame,
    keys: list[str],
    measures: dict[str, Column],
    date: str = "date",
) -> DataFrame:
    """``intervals`` with a column per measure: its sum over the facts of the same keys from ``start`` to ``end``.

    ``keys`` are equality columns of both sides, NULL ones match nothing; both
    ends count. Sums over no facts, reversed intervals and NULL ends are 0.
    """
    names = list(measures)
    low, high = _reach(intervals, start, end)
    near = facts.filter((F.col(date) >= low) & (F.col(date) <= high))
    daily = near.groupBy(*keys, F.col(date).alias("_day")).agg(*[F.sum(m).cast(TOTAL).alias(n) for n, m in measures.items()])
    before, last = F.date_sub(start, 1), F.greatest(F.date_sub(start, 1), F.col(end))
    marks = intervals.select(*keys, F.explode(F.array(before, last)).alias("_day")).distinct().select(
        *keys, "_day", *[F.lit(None).cast(TOTAL).alias(n) for n in names], F.lit(True).alias("_mark"))
    upto = Window.partitionBy(*keys).orderBy("_day", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.withColumn("_mark", F.lit(False)).unionByName(marks).select(
        *keys, "_day", "_mark", F.struct(*[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in names]).alias("_sums"))
    run = run.filter("_mark").select(*keys, "_day", "_sums")
    upper = run.withColumnsRenamed({"_day": "_last", "_sums": "_upper"})
    lower = run.withColumnsRenamed({"_day": "_before", "_sums": "_lower"})
    found = intervals.withColumns({"_before": before, "_last": last}).join(
        upper, [*keys, "_last"], "left").join(lower, [*keys, "_before"], "left")
    return found.select(*intervals.columns, *[
        F.coalesce(F.col("_upper")[n] - F.col("_lower")[n], F.lit(0)).cast(TOTAL).alias(n) for n in names])
