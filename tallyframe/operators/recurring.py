"""Recurring templates: which are due, and the rows they create."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.operators.filters import filter_by_date_range
from tallyframe.plans.keys import category_lookup
from tallyframe.schema import RECURRING_SUFFIX, TOTAL

# A template creates at most one row per day among rows equal in these columns.
TWIN_KEYS = ["date", "user_id", "account_id", "amount", "type", "category_id"]


def _is_due(day: Column, honor_end_date: bool) -> Column:
    start = F.col("start_date")
    same_day = F.dayofmonth(day) == F.dayofmonth(start)
    frequency = F.col("frequency")
    due = (start <= day) & (
        (frequency == "daily")
        | ((frequency == "weekly") & (F.weekday(day) == 0))
        | ((frequency == "monthly") & same_day)
        | ((frequency == "yearly") & same_day & (F.month(day) == F.month(start)))
    )
    if honor_end_date:
        due = due & (F.col("end_date").isNull() | (F.col("end_date") >= day))
    return due


def recurring_due(recurring: DataFrame, as_of: dt.date, honor_end_date: bool = False) -> DataFrame:
    """Templates due on a day. Weekly ones fire on Mondays whatever their start day."""
    return recurring.filter(_is_due(F.lit(as_of), honor_end_date)).withColumn("date", F.lit(as_of))


def recurring_due_range(
    recurring: DataFrame, date_from: dt.date, date_to: dt.date, honor_end_date: bool = False
) -> DataFrame:
    """Due (template, day) pairs for every day of an inclusive range; an empty range has none."""
    if date_to < date_from:
        return recurring.withColumn("date", F.lit(date_from)).filter("false")
    last = F.lit(date_to)
    if honor_end_date:
        last = F.least(last, F.coalesce("end_date", F.lit(date_to)))
    rows = recurring.withColumns({"_first": F.greatest("start_date", F.lit(date_from)), "_last": last})
    return rows.filter("_first <= _last").withColumn("date", F.explode(_due_dates())).drop("_first", "_last")


def _due_dates() -> Column:
    """Due dates from ``_first`` to ``_last``, generated by the frequency's own step.

    A month or year without the start's day has none: the day is counted from
    the month's first and dropped where it falls into the next month.
    """
    def steps(first: str, unit: str) -> str:
        return f"sequence({first}, _last, INTERVAL 1 {unit})"

    def on_day(firsts: str) -> str:
        dated = f"transform({firsts}, m -> struct(m, date_add(m, day(start_date) - 1) AS d))"
        return f"transform(filter({dated}, x -> trunc(x.d, 'MM') = x.m AND x.d BETWEEN _first AND _last), x -> x.d)"

    monday = "next_day(date_sub(_first, 1), 'MO')"
    year = "make_date(year(_first), month(start_date), 1)"
    none = "CAST(array() AS ARRAY<DATE>)"
    return F.expr(f"""CASE frequency
        WHEN 'daily' THEN {steps("_first", "DAY")}
        WHEN 'weekly' THEN CASE WHEN {monday} <= _last THEN {steps(monday, "WEEK")} ELSE {none} END
        WHEN 'monthly' THEN {on_day(steps("trunc(_first, 'MM')", "MONTH"))}
        WHEN 'yearly' THEN {on_day(f"CASE WHEN {year} <= _last THEN {steps(year, 'YEAR')} ELSE {none} END")}
        ELSE {none} END""")


def recurring_antijoin(
    due: DataFrame, transactions: DataFrame, date_from: dt.date, date_to: dt.date
) -> DataFrame:
    """Due rows without an equal row on the day; of twin templates the lowest id stays.

    NULL account and category equal NULL. Existing rows are pruned to the days
    in question and reduced to distinct keys before the join.
    """
    single = due.groupBy(*TWIN_KEYS).agg(
        F.min_by(F.struct(*[c for c in due.columns if c not in TWIN_KEYS]), "id").alias("r")
    )
    single = single.select(*TWIN_KEYS, "r.*").select(*due.columns)
    existing = filter_by_date_range(transactions, date_from, date_to).select(*TWIN_KEYS).distinct()
    same = [single[k].eqNullSafe(existing[k]) for k in TWIN_KEYS]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return single.join(existing, condition, "left_anti")


def agrees_with_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows whose category, if set, has the row's own type."""
    looked = category_lookup(rows, categories, spread="id")
    ok = F.col("category_id").isNull() | F.coalesce(F.col("category_type") == F.col("type"), F.lit(False))
    return looked.filter(ok).select(*rows.columns)


def materialize_recurring(
    recurring: DataFrame,
    categories: DataFrame,
    transactions: DataFrame,
    date_from: dt.date,
    date_to: dt.date | None = None,
    suffix: str = RECURRING_SUFFIX,
    honor_end_date: bool = False,
) -> DataFrame:
    """Ledger rows the job adds for one day, or for each day of a range.

    Templates that disagree with their category are skipped and the run goes
    on. A second run over the result adds nothing.
    """
    if date_to is None or date_to == date_from:
        date_to = date_from
        due = recurring_due(recurring, date_from, honor_end_date)
    else:
        due = recurring_due_range(recurring, date_from, date_to, honor_end_date)
    fresh = recurring_antijoin(agrees_with_category(due, categories), transactions, date_from, date_to)
    return fresh.select(
        F.col("id").alias("recurring_id"),
        "user_id",
        "type",
        "amount",
        "date",
        F.concat(X.null_text("description"), F.lit(suffix)).alias("description"),
        "category_id",
        "account_id",
    )


def apply_to_balances(stored: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Stored account balances after adding ``new_rows``."""
    change = new_rows.filter("account_id IS NOT NULL").groupBy("account_id").agg(
        F.sum(X.signed_amount()).alias("_change")
    )
    joined = stored.join(change, stored["id"] == change["account_id"], "left")
    return joined.withColumn("balance", (F.col("balance") + F.coalesce("_change", F.lit(0))).cast(TOTAL)).select(
        *stored.columns
    )


def recurring_list(recurring: DataFrame, categories: DataFrame, lang: str = "en") -> DataFrame:
    """Template list as text, newest id first."""
    rows = category_lookup(recurring, categories, spread="id")
    label = X.category_label("category_name", "category_is_system", lang)
    return rows.select(
        "id",
        "user_id",
        "type",
        X.null_text(label).alias("category_text"),
        X.list_date("start_date").alias("start_text"),
        X.null_text(X.list_date("end_date")).alias("end_text"),
        "amount",
        "frequency",
        X.cut_text(X.null_text("description")).alias("description_text"),
    ).orderBy(F.col("id").desc())
