"""Column expressions shared by the operators; all of them run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.schema import (
    ACCOUNT_TYPE_LABELS,
    INCOME,
    INCOME_CATEGORY_LABELS,
    OUTCOME,
    OUTCOME_CATEGORY_LABELS,
    PERIOD_LABELS,
    TOTAL,
)
from tallyframe.sources.literals import sql_literal


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- money -----------------------------------------------------------------

def signed_amount(type_: str | Column = "type", amount: str | Column = "amount") -> Column:
    return F.when(col(type_) == INCOME, col(amount)).otherwise(-col(amount))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0)).cast(TOTAL)


def sum_where(kind: str, amount: str = "amount") -> Column:
    return or_zero(F.sum(F.when(F.col("type") == kind, F.col(amount))))


def income_sum() -> Column:
    return sum_where(INCOME)


def outcome_sum() -> Column:
    return sum_where(OUTCOME)


def percent_rounded(part: str | Column, whole: str | Column) -> Column:
    """Percentage with two decimals, NULL for a missing or zero limit."""
    return F.round(F.try_divide(col(part) * 100, col(whole)), 2).cast("double")


def percent_raw(part: str | Column, whole: str | Column) -> Column:
    """Unrounded percentage, 0 for a missing or non-positive limit."""
    ratio = col(part).cast("double") / col(whole).cast("double") * F.lit(100.0)
    return F.when(col(whole) > 0, ratio).otherwise(F.lit(0.0))


def clamp_percent(p: str | Column, top: float = 100.0) -> Column:
    return F.least(col(p), F.lit(top))


def fixed_text(c: str | Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals, without grouping."""
    return col(c).cast(f"decimal(38,{digits})").cast("string")


def money_text(amount: str | Column, symbol: str | Column) -> Column:
    return F.concat(col(amount).cast("string"), F.lit(" "), F.coalesce(col(symbol), F.lit("")))


# --- dates -----------------------------------------------------------------

def month_of(d: str | Column) -> Column:
    return F.trunc(col(d), "MM")


def monday_of(d: str | Column) -> Column:
    return F.trunc(col(d), "WEEK")


def iso_year(d: str | Column) -> Column:
    # The ISO year is the year of the week's Thursday.
    return F.year(F.date_add(monday_of(d), 3))


def day_month(d: Column) -> Column:
    return F.concat(F.day(d).cast("string"), F.date_format(d, "MMM"))


def week_label(monday: Column) -> Column:
    return F.concat(day_month(monday), F.lit("-"), day_month(F.date_add(monday, 6)))


def week_of_year_monday(year: Column, week: Column) -> Column:
    """Monday of week ``week`` when week 1 starts at the year's first Monday."""
    first = F.next_day(F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), 1), "Mon")
    return F.date_add(first, (week - 1) * 7)


def short_date(d: str | Column) -> Column:
    return F.date_format(col(d), "MMM dd, yyyy")


def long_date(d: str | Column) -> Column:
    return F.date_format(col(d), "MMMM dd, yyyy")


def list_date(d: str | Column) -> Column:
    """Default list rendering of a date, e.g. ``Jan. 5, 2024``."""
    # Month names as the lists abbreviate them.
    names = ["Jan.", "Feb.", "March", "April", "May", "June",
             "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."]
    month = F.element_at(F.expr("array(" + ", ".join(map(sql_literal, names)) + ")"), F.month(col(d)))
    return F.concat(month, F.lit(" "), F.day(col(d)).cast("string"), F.lit(", "), F.year(col(d)).cast("string"))


def period_start(period: str | Column, as_of: str | Column) -> Column:
    p, d = col(period), col(as_of)
    return (
        F.when(p == "MONTHLY", F.trunc(d, "MM"))
        .when(p == "QUARTERLY", F.trunc(d, "QUARTER"))
        .when(p == "YEARLY", F.trunc(d, "YEAR"))
    )


def period_end(period: str | Column, as_of: str | Column) -> Column:
    p, start = col(period), period_start(period, as_of)
    months = F.when(p == "MONTHLY", 1).when(p == "QUARTERLY", 3).when(p == "YEARLY", 12)
    return F.date_sub(F.add_months(start, months), 1)


# --- text ------------------------------------------------------------------

def contains_text(c: str | Column, needle: str) -> Column:
    """Case-insensitive literal substring; NULL never matches."""
    return F.coalesce(F.lower(col(c)).contains(needle.lower()), F.lit(False))


def cut_text(c: str | Column, width: int = 20) -> Column:
    c = col(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)


def text_or(c: str | Column, fallback: str) -> Column:
    """Fallback for NULL and for the empty string."""
    return F.when(col(c).isNull() | (col(c) == ""), F.lit(fallback)).otherwise(col(c))


def null_text(c: str | Column) -> Column:
    """NULL shown as the word None, as the lists print it."""
    return F.coalesce(col(c), F.lit("None"))


# --- labels ----------------------------------------------------------------

def _literal_map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(sql_literal(x) for pair in pairs.items() for x in pair) + ")")


def category_label(name: str | Column, is_system: str | Column, lang: str = "en") -> Column:
    """Label of a system category; own names and unknown keys stay as they are."""
    at = {"en": 0, "ru": 1}[lang]
    labels = {k: v[at] for k, v in {**OUTCOME_CATEGORY_LABELS, **INCOME_CATEGORY_LABELS}.items()}
    found = F.try_element_at(_literal_map(labels), col(name))
    return F.when(col(is_system), F.coalesce(found, col(name))).otherwise(col(name))


def account_type_label(c: str | Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(ACCOUNT_TYPE_LABELS), col(c)), col(c))


def period_label(c: str | Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(PERIOD_LABELS), col(c)), col(c))


# --- json ------------------------------------------------------------------

def row_json(*names: str) -> Column:
    """Row image as JSON text that keeps NULL fields."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
