"""Period statistics per user: totals, days, categories, calendar heatmap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.plans.keys import category_lookup
from tallyframe.schema import OUTCOME, TOTAL, WEEKDAYS

OTHER = "Other"


def _owned(df: DataFrame) -> DataFrame:
    return df.filter(F.col("user_id").isNotNull())


def period_totals(df: DataFrame) -> DataFrame:
    income, expense = X.income_sum(), X.outcome_sum()
    return _owned(df).groupBy("user_id").agg(
        income.alias("total_income"), expense.alias("total_expense"), (income - expense).cast(TOTAL).alias("balance")
    )


def daily_income_expense(df: DataFrame) -> DataFrame:
    return _owned(df).groupBy("user_id", F.col("date").alias("day")).agg(
        X.income_sum().alias("income"), X.outcome_sum().alias("expense")
    )


def day_labels(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.col("date").cast("string").alias("day")).distinct().orderBy("user_id", "day")


def chart_series(df: DataFrame) -> DataFrame:
    """Aligned arrays per user: day labels, income and expense values.

    The arrays are collected from one row per user and day, so their length is
    bounded by the calendar.
    """
    days = daily_income_expense(df).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("day", "income", "expense"))).alias("d")
    )
    return days.select(
        "user_id",
        F.transform("d", lambda x: x["day"].cast("string")).alias("labels"),
        F.transform("d", lambda x: x["income"].cast("double")).alias("income_data"),
        F.transform("d", lambda x: x["expense"].cast("double")).alias("expense_data"),
    )


def _labelled(sums: DataFrame, categories: DataFrame, lang: str) -> DataFrame:
    """``sums`` holds one row per (user, category); NULL or unknown categories become Other."""
    rows = category_lookup(sums, categories, spread="user_id")
    label = X.category_label("category_name", "category_is_system", lang)
    return rows.withColumn("category", X.text_or(label, OTHER))


def expense_by_category(df: DataFrame, categories: DataFrame, lang: str = "en") -> DataFrame:
    sums = _owned(df).filter(F.col("type") == OUTCOME).groupBy("user_id", "category_id").agg(
        F.sum("amount").cast(TOTAL).alias("total")
    )
    return _labelled(sums, categories, lang).select("user_id", "category_id", "category", "total")


def expense_frequency(df: DataFrame, categories: DataFrame, lang: str = "en") -> DataFrame:
    counts = _owned(df).filter(F.col("type") == OUTCOME).groupBy("user_id", "category_id").agg(
        F.count(F.lit(1)).alias("count")
    )
    return _labelled(counts, categories, lang).select("user_id", "category_id", "category", "count")


def _week_start(label_mode: str):
    if label_mode == "iso":
        return F.col("_monday")
    if label_mode == "week_of_year":
        return X.week_of_year_monday(F.col("iso_year"), F.col("week"))
    raise ValueError(f"unknown label mode {label_mode!r}")


def expense_heatmap(df: DataFrame, label_mode: str = "iso") -> DataFrame:
    """OUTCOME sum per user, ISO week and weekday, with the week's label.

    ``label_mode="week_of_year"`` labels weeks counted from the year's first Monday.
    """
    daily = _owned(df).filter(F.col("type") == OUTCOME).groupBy("user_id", "date").agg(
        F.sum("amount").cast(TOTAL).alias("heat")
    )
    rows = daily.withColumns({
        "_monday": X.monday_of("date"),
        "iso_year": X.iso_year("date"),
        "week": F.weekofyear("date"),
        "weekday_num": F.weekday("date"),
        "weekday": F.date_format("date", "EEEE"),
    })
    # A date is one (ISO year, week, weekday) cell, so the daily sums are the cells.
    return rows.select(
        "user_id", "iso_year", "week", "weekday_num", "weekday",
        X.week_label(_week_start(label_mode)).alias("week_label"), "heat",
    )


def heatmap_week_labels(df: DataFrame, label_mode: str = "iso", label_scope: str = "year") -> DataFrame:
    """Distinct weeks in order. ``label_scope="global"`` merges equal (week, label) pairs of different years."""
    weeks = expense_heatmap(df, label_mode).select("user_id", "iso_year", "week", "week_label").distinct()
    if label_scope == "global":
        weeks = weeks.groupBy("user_id", "week", "week_label").agg(F.min("iso_year").alias("iso_year"))
        weeks = weeks.select("user_id", "iso_year", "week", "week_label")
    return weeks.orderBy("user_id", "iso_year", "week")


def heatmap_grid(df: DataFrame, label_mode: str = "iso") -> DataFrame:
    """Every week with all seven weekdays; days without expenses have NULL heat."""
    cells = expense_heatmap(df, label_mode)
    weeks = cells.select("user_id", "iso_year", "week", "week_label").distinct()
    days = F.array(*[F.struct(F.lit(i).alias("weekday_num"), F.lit(n).alias("weekday")) for i, n in enumerate(WEEKDAYS)])
    grid = weeks.select("*", F.inline(days).alias("weekday_num", "weekday"))
    heats = cells.select("user_id", "iso_year", "week", "weekday_num", "heat")
    return grid.join(heats, ["user_id", "iso_year", "week", "weekday_num"], "left").select(
        "user_id", "iso_year", "week", "week_label", "weekday_num", "weekday", "heat"
    )


def stats_bundle(df: DataFrame, categories: DataFrame, lang: str = "en") -> DataFrame:
    """All statistics of one filtered set as long rows, from one scan.

    The set is summed once to (user, day, category, type) and the sections are
    grouping sets over that; ``section`` tells them apart.
    """
    base = _owned(df).groupBy("user_id", "date", "category_id", "type").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")
    )
    user, day, cat = F.col("user_id"), F.col("date"), F.col("category_id")
    income, expense = X.income_sum(), X.outcome_sum()
    sets = base.groupingSets([[user], [user, day], [user, cat]], user, day, cat).agg(
        income.alias("income"),
        expense.alias("expense"),
        F.coalesce(F.sum(F.when(F.col("type") == OUTCOME, F.col("n"))), F.lit(0)).alias("expense_count"),
        F.grouping_id().alias("gid"),
    )
    # grouping_id bits: 2 for day folded away, 1 for category folded away.
    section = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "day").otherwise("category")
    rows = sets.withColumn("section", section).filter("section <> 'category' OR expense_count > 0")
    rows = _labelled(rows, categories, lang)
    is_day, is_cat = F.col("section") == "day", F.col("section") == "category"
    heat = is_day & (F.col("expense_count") > 0)
    return rows.select(
        "user_id",
        "section",
        "date",
        F.when(is_cat, F.col("category_id")).alias("category_id"),
        F.when(is_cat, F.col("category")).alias("category"),
        F.when(~is_cat, F.col("income")).alias("income"),
        "expense",
        F.when(F.col("section") == "total", (F.col("income") - F.col("expense")).cast(TOTAL)).alias("balance"),
        F.when(is_cat, F.col("expense_count")).alias("frequency"),
        F.when(heat, X.iso_year("date")).alias("iso_year"),
        F.when(heat, F.weekofyear("date")).alias("week"),
        F.when(heat, F.weekday("date")).alias("weekday_num"),
        F.when(heat, X.week_label(X.monday_of("date"))).alias("week_label"),
    )
