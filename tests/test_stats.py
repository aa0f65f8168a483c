import datetime as dt

import pytest
from ledger_rows import by, day, money, rows
from pyspark.sql import functions as F

from tallyframe.operators import stats


@pytest.fixture(scope="module")
def t(small):
    return small.transactions(
        (1, 1, "OUTCOME", 10, "1996-12-31", 11), (2, 1, "OUTCOME", 1, "1997-01-01", 11), (3, 1, "OUTCOME", 2, "1997-01-05"),
        (4, 1, "INCOME", 50, "1997-01-05", 1), (5, 1, "OUTCOME", 4, "1997-01-06", 77), (6, 1, "OUTCOME", 3, "1998-01-01", 11),
        (7, 1, "OUTCOME", 8, "2020-12-31", 11), (8, 1, "OUTCOME", 9, "2021-01-01", 11), (9, 2, "INCOME", 5, "2021-01-03"),
        (10, None, "OUTCOME", 5, "2021-01-03", 11),
    )


@pytest.fixture(scope="module")
def cats(small):
    return small.categories((1, "salary", "INCOME", None), (11, "shopping", "OUTCOME", None))


def test_totals_and_days(t):
    got = by(stats.period_totals(t), "user_id")
    assert set(got) == {1, 2}
    assert (got[1]["total_income"], got[1]["total_expense"], got[1]["balance"]) == (money(50), money(37), money(13))
    assert got[2]["total_expense"] == money(0)
    days = by(stats.daily_income_expense(t), "user_id", "day")
    assert (days[1, day("1997-01-05")]["income"], days[1, day("1997-01-05")]["expense"]) == (money(50), money(2))


def test_chart_arrays_are_aligned_and_ascending(t):
    got = by(stats.chart_series(t), "user_id")
    assert got[1]["labels"] == sorted(got[1]["labels"]) and len(got[1]["labels"]) == 7
    assert got[1]["income_data"] == [0, 0, 50, 0, 0, 0, 0]
    assert got[1]["expense_data"] == [10, 1, 2, 4, 3, 8, 9]
    assert got[1]["labels"] == [r[0] for r in rows(stats.day_labels(t).filter("user_id = 1").select("day"))]


def test_categories_with_other(t, cats):
    got = {(r.category_id, r.category): r.total for r in stats.expense_by_category(t, cats).collect()}
    assert got == {(11, "Shopping"): money(31), (None, "Other"): money(2), (77, "Other"): money(4)}
    ru = {r.category_id: (r.category, r["count"]) for r in stats.expense_frequency(t, cats, "ru").collect()}
    assert ru[11] == ("Покупки", 5) and ru[None] == ("Other", 1)


def test_heatmap_iso_weeks_and_labels(t):
    got = {(r.iso_year, r.week, r.weekday_num): r for r in stats.expense_heatmap(t).collect()}
    assert {k: r.heat for k, r in got.items()} == {
        (1997, 1, 1): money(10), (1997, 1, 2): money(1), (1997, 1, 6): money(2), (1997, 2, 0): money(4),
        (1998, 1, 3): money(3), (2020, 53, 3): money(8), (2020, 53, 4): money(9)}
    assert got[1997, 1, 1].week_label == "30Dec-5Jan"
    assert got[2020, 53, 4].week_label == "28Dec-3Jan" and got[2020, 53, 4].weekday == "Friday"
    labels = [r.week_label for r in stats.heatmap_week_labels(t).collect()]
    assert labels == ["30Dec-5Jan", "6Jan-12Jan", "29Dec-4Jan", "28Dec-3Jan"]


def test_week_of_year_label_counts_from_the_first_monday(spark, small):
    days = [dt.date(2019, 1, 1) + dt.timedelta(n) for n in range(0, 2600, 3)]
    t = small.transactions(*[(i, 1, "OUTCOME", 1, d.isoformat()) for i, d in enumerate(days)])
    for r in stats.expense_heatmap(t, "week_of_year").select("iso_year", "week", "week_label").distinct().collect():
        monday = dt.datetime.strptime(f"{r.iso_year}-{r.week}-1", "%Y-%W-%w").date()
        sunday = monday + dt.timedelta(6)
        assert r.week_label == f"{monday.day}{monday:%b}-{sunday.day}{sunday:%b}"


def test_global_labels_merge_equal_pairs_of_years(small):
    # Weeks of 2001 and 2007 start on the same days.
    t = small.transactions((1, 1, "OUTCOME", 1, "2001-01-03"), (2, 1, "OUTCOME", 1, "2007-01-03"))
    assert stats.heatmap_week_labels(t).count() == 2
    assert stats.heatmap_week_labels(t, label_scope="global").count() == 1


def test_grid_is_full_and_keeps_the_total(t):
    grid = stats.heatmap_grid(t)
    assert grid.count() == 7 * 4
    assert grid.agg(F.sum("heat")).first()[0] == stats.expense_heatmap(t).agg(F.sum("heat")).first()[0]
    assert grid.filter("heat IS NULL").count() == 28 - 7


def test_bundle_repeats_the_single_statistics(t, cats):
    bundle = stats.stats_bundle(t, cats)
    total = by(bundle.filter("section = 'total'"), "user_id")
    assert {u: (r["income"], r["expense"], r["balance"]) for u, r in total.items()} == {
        u: (r["total_income"], r["total_expense"], r["balance"]) for u, r in by(stats.period_totals(t), "user_id").items()}
    days = bundle.filter("section = 'day'").select("user_id", F.col("date").alias("day"), "income", "expense")
    assert set(rows(days)) == set(rows(stats.daily_income_expense(t)))
    part = bundle.filter("section = 'category'")
    assert set(rows(part.select("user_id", "category_id", "category", "expense"))) == set(rows(stats.expense_by_category(t, cats)))
    assert set(rows(part.select("category_id", "frequency"))) == set(rows(stats.expense_frequency(t, cats).select("category_id", "count")))
    heat = bundle.filter("week IS NOT NULL").select("iso_year", "week", "weekday_num", "week_label", "expense")
    assert set(rows(heat)) == set(rows(stats.expense_heatmap(t).select("iso_year", "week", "weekday_num", "week_label", "heat")))
