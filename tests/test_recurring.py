import pytest
from ledger_rows import day, money, rows

from tallyframe.operators import recurring
from tallyframe.streaming import nightly


@pytest.fixture(scope="module")
def templates(small):
    return small.recurring(
        (1, 1, 10, 5, "OUTCOME", 11, "a", "daily", "2024-01-15"),
        (2, 1, 10, 6, "OUTCOME", 11, "b", "weekly", "2024-01-17"),
        (3, 1, 10, 7, "OUTCOME", 11, None, "monthly", "2024-01-31"),
        (4, 1, None, 8, "OUTCOME", None, "d", "yearly", "2020-02-29"),
        (5, 1, 10, 9, "OUTCOME", 11, "e", "daily", "2024-01-01", "2024-01-20"),
    )


def due(df, text, **kw):
    return sorted(r[0] for r in rows(recurring.recurring_due(df, day(text), **kw).select("id")))


def test_due_rules(templates):
    assert due(templates, "2024-01-14") == [5]
    assert due(templates, "2024-01-15") == [1, 5]
    assert due(templates, "2024-01-22") == [1, 2, 5]
    assert due(templates, "2024-01-31") == [1, 3, 5]
    assert due(templates, "2024-02-29") == [1, 4, 5]
    assert due(templates, "2024-04-30") == [1, 5]
    assert due(templates, "2025-02-28") == [1, 5]
    assert due(templates, "2024-01-21", honor_end_date=True) == [1]


def test_range_is_the_union_of_days(templates):
    got = sorted(rows(recurring.recurring_due_range(templates, day("2024-01-28"), day("2024-03-01")).select("date", "id")))
    want = []
    for n in range(34):
        d = day("2024-01-28").toordinal() + n
        d = day("2024-01-01").fromordinal(d)
        want += [(d, i) for i in due(templates, d.isoformat())]
    assert got == sorted(want)


@pytest.fixture(scope="module")
def cats(small):
    return small.categories((11, "shopping", "OUTCOME", None), (1, "salary", "INCOME", None))


def test_twins_nulls_and_category_disagreement(small, cats):
    r = small.recurring(
        (1, 1, None, 5, "OUTCOME", None, "x", "daily", "2024-01-01"),
        (2, 1, None, 5, "OUTCOME", None, "y", "daily", "2024-01-01"),
        (3, 1, 10, 5, "INCOME", 11, "wrong type", "daily", "2024-01-01"),
        (4, 1, 10, 5, "OUTCOME", 11, None, "daily", "2024-01-01"),
        (5, 2, 10, 5, "OUTCOME", 11, "stored", "daily", "2024-01-01"),
        (6, 2, None, 5, "OUTCOME", None, "stored", "daily", "2024-01-01"),
    )
    t = small.transactions((90, 2, "OUTCOME", 5, "2024-01-05", 11, 10), (91, 2, "OUTCOME", 5, "2024-01-05"),
                           (92, 1, "OUTCOME", 5, "2024-01-04", 11, 10))
    made = recurring.materialize_recurring(r, cats, t, day("2024-01-05"))
    assert sorted(rows(made.select("recurring_id", "description"))) == [
        (1, "x (автоматически создано)"), (4, "None (автоматически создано)")]
    # A second run over the result adds nothing.
    again = t.unionByName(made.selectExpr("recurring_id + 1000 AS id", *[c for c in t.columns if c != "id"]))
    assert recurring.materialize_recurring(r, cats, again, day("2024-01-05")).count() == 0
    stored = small.accounts((10, 1, 100))
    assert rows(recurring.apply_to_balances(stored, made).select("balance")) == [(money(95),)]


def test_nightly_equals_day_by_day(spark, small, cats, templates, tmp_path):
    t = small.transactions((90, 1, "OUTCOME", 5, "2024-01-30", 11, 10))
    week = nightly.run_nightly(spark, templates, cats, t, day("2024-01-27"), day("2024-02-02"), str(tmp_path))
    single = []
    for n in range(6):
        d = day("2024-01-28").fromordinal(day("2024-01-28").toordinal() + n)
        single += rows(recurring.materialize_recurring(templates, cats, t, d).select("recurring_id", "date"))
    assert sorted(rows(week.select("recurring_id", "date"))) == sorted(single)
    # A repeated run replaces its folder.
    again = nightly.run_nightly(spark, templates, cats, t, day("2024-01-27"), day("2024-02-02"), str(tmp_path))
    assert again.count() == len(single)


def test_list_text(small, cats, templates):
    got = rows(recurring.recurring_list(templates, cats).select("id", "category_text", "start_text", "end_text", "description_text"))
    assert got[0] == (5, "Shopping", "Jan. 1, 2024", "Jan. 20, 2024", "e")
    assert got[1] == (4, "None", "Feb. 29, 2020", "None", "d")
    assert got[2][-1] == "None"
