"""Totals over date intervals without a range join.

An interval is cut into whole calendar years, whole months and single days;
the facts are summed once per day, month and year. The interval join is then
a plain equi-join on (keys, grain, cell), which hashes evenly: a user with a
third of all rows meets at most one cell row per day, and a year-long budget
reads one cell instead of 365.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.keys import evenly, shuffled
from tallyframe.schema import TOTAL


def _steps(lo: str, hi: str, step: str, when: str = "true") -> str:
    """First days of the steps in [lo, hi), none unless ``when`` holds."""
    days = f"sequence({lo}, date_sub({hi}, 1), INTERVAL 1 {step})"
    return f"CASE WHEN {when} AND {lo} < {hi} THEN {days} ELSE CAST(array() AS ARRAY<DATE>) END"


def interval_cells(df: DataFrame, start: str, end: str) -> DataFrame:
    """Explode each inclusive [start, end] into columns ``grain`` and ``cell``.

    _s and _e bound the interval half-open; _m0, _m1 its whole months; _y0, _y1
    its whole years.
    """
    months, years = "_m0 <= _m1", "_y0 <= _y1"
    grains = {
        "D": f"concat({_steps('_s', f'IF({months}, _m0, _e)', 'DAY')}, {_steps('_m1', '_e', 'DAY', months)})",
        "M": f"concat({_steps('_m0', f'IF({years}, _y0, _m1)', 'MONTH', months)}, {_steps('_y1', '_m1', 'MONTH', years)})",
        "Y": _steps("_y0", "_y1", "YEAR", years),
    }
    pairs = ", ".join(f"struct('{g}' AS grain, {cells} AS cells)" for g, cells in grains.items())
    columns = df.columns
    return (
        df.selectExpr("*", f"{start} AS _s", f"date_add({end}, 1) AS _e")
        .selectExpr(
            "*",
            "IF(trunc(_s, 'MM') = _s, _s, add_months(trunc(_s, 'MM'), 1)) AS _m0",
            "trunc(_e, 'MM') AS _m1",
            "IF(trunc(_s, 'YEAR') = _s, _s, add_months(trunc(_s, 'YEAR'), 12)) AS _y0",
            "trunc(_e, 'YEAR') AS _y1",
        )
        .selectExpr(*columns, f"inline(array({pairs})) AS (grain, _cells)")
        .selectExpr(*columns, "grain", "explode(_cells) AS cell")
    )


def fact_cells(facts: DataFrame, keys: list[str], measures: dict[str, Column], date: str = "date") -> DataFrame:
    """Sum ``measures`` per keys and day, then roll the days up to months and years.

    Measures are sums and counts, so the second step adds the first; it holds
    a key's days together, however many rows they have.
    """
    daily = facts.groupBy(*keys, date).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    grains = F.array(
        F.struct(F.lit("D").alias("grain"), F.col(date).alias("cell")),
        F.struct(F.lit("M").alias("grain"), F.trunc(date, "MM").alias("cell")),
        F.struct(F.lit("Y").alias("grain"), F.trunc(date, "YEAR").alias("cell")),
    )
    return (
        evenly(daily, *keys).select(*keys, *measures, F.inline(grains).alias("grain", "cell"))
        .groupBy(*keys, "grain", "cell")
        .agg(*[F.sum(n).alias(n) for n in measures])
    )


def interval_totals(
    intervals: DataFrame,
    interval_id: str,
    start: str,
    end: str,
    facts: DataFrame,
    keys: list[str],
    measures: dict[str, Column],
    carry: list[str] | None = None,
) -> DataFrame:
    """Totals per interval (and per ``carry`` fact column), NULL for an interval without facts.

    ``keys`` are equality columns present on both sides. The exploded side
    looks smaller to the optimizer than it is and is not broadcast.
    """
    carry = carry or []
    cells = fact_cells(facts, keys + carry, measures)
    spans = interval_cells(intervals.select(interval_id, *keys, start, end), start, end)
    return (
        shuffled(evenly(spans.select(interval_id, *keys, "grain", "cell"), *keys, "grain", "cell"))
        .join(cells, [*keys, "grain", "cell"], "left")
        .groupBy(interval_id, *carry)
        .agg(*[F.sum(n).cast(TOTAL).alias(n) for n in measures])
    )


def month_span(df: DataFrame, start: str, end: str, name: str = "_month") -> DataFrame:
    """One row per calendar month an inclusive interval touches; a reversed interval touches none."""
    months = F.sequence(F.trunc(start, "MM"), F.greatest(F.trunc(start, "MM"), F.trunc(end, "MM")), F.expr("INTERVAL 1 MONTH"))
    return df.filter(F.col(start) <= F.col(end)).withColumn(name, F.explode(months))
