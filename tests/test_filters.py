import pytest
from ledger_rows import day, money, rows
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.operators import filters, joins, sorting


@pytest.fixture(scope="module")
def t(small):
    return small.transactions(
        (1, 1, "INCOME", 10, "2024-01-01", 1, 10, "100% Bonus"), (2, 1, "OUTCOME", 5, "2024-01-31", None, 10, "rent_due"),
        (3, 1, "OUTCOME", 5, "2024-02-01", 11, 11, None), (4, 2, "OUTCOME", 8, "2024-01-31", 11, 20, "RENT"),
        (5, None, "OUTCOME", 8, "2024-01-15", 11, None, "renter"),
    )


def ids(df):
    return sorted(r[0] for r in rows(df.select("id")))


def test_description_is_a_literal_case_insensitive_substring(t):
    assert ids(filters.filter_by_description(t, "%")) == [1]
    assert ids(filters.filter_by_description(t, "_")) == [2]
    assert ids(filters.filter_by_description(t, "rent")) == [2, 4, 5]
    assert ids(filters.filter_by_description(t, "")) == [1, 2, 3, 4, 5]


def test_category_and_type_sentinels(t):
    assert ids(filters.filter_by_category(t, "Other")) == [2]
    assert ids(filters.filter_by_category(t, "Nocategory")) == ids(filters.filter_by_category(t, "")) == [1, 2, 3, 4, 5]
    assert ids(filters.filter_by_category(t, "11")) == [3, 4, 5]
    assert ids(filters.filter_by_type(t, "Notype")) == [1, 2, 3, 4, 5]
    assert ids(filters.filter_by_type(t, "INCOME")) == [1]


def test_dates_inclusive_and_optional(t):
    assert ids(filters.filter_by_date_range(t, day("2024-01-31"), day("2024-02-01"))) == [2, 3, 4]
    assert ids(filters.filter_by_date_range(t, None, day("2024-01-01"))) == [1]
    assert ids(filters.filter_by_date_range(t)) == [1, 2, 3, 4, 5]


def test_account_choice_is_limited_to_own_active_accounts(t, small):
    accounts = small.accounts((10, 1, 0), (11, 1, 0, False), (20, 2, 0))
    assert ids(filters.filter_by_account(t, 10, accounts, 1)) == [1, 2]
    assert ids(filters.filter_by_account(t, 11, accounts, 1)) == []
    assert ids(filters.filter_by_account(t, 20, accounts, 1)) == []
    assert ids(filters.filter_by_account(t, 11)) == [3]


def test_search_combines_and_sorts_newest_first(t):
    got = filters.transaction_search(t, user_id=1, kind="OUTCOME", date_from=day("2024-01-01"))
    assert [r[0] for r in rows(got.select("id"))] == [3, 2]
    by_amount = filters.transaction_search(t, sort_by="amount")
    assert [r[0] for r in rows(by_amount.select("id"))] == [2, 3, 4, 5, 1]
    with pytest.raises(ValueError):
        sorting.sort_transactions(t, "user_id")


def test_visible_categories_are_system_and_own(small):
    c = small.categories((1, "salary", "INCOME", None), (2, "food", "OUTCOME", None), (3, "own", "OUTCOME", 1), (4, "x", "OUTCOME", 2))
    assert ids(filters.visible_categories(c, 1)) == [1, 2, 3]
    assert ids(filters.visible_categories(c, 1, "OUTCOME")) == [2, 3]
    assert ids(filters.categories_by_type(c, "OUTCOME")) == [2, 3, 4]
    assert ids(filters.categories_by_type(c, "Notype")) == [1, 2, 3, 4]


@pytest.mark.parametrize(("kind", "start", "end"), [
    ("MONTHLY", "2024-02-01", "2024-02-29"), ("QUARTERLY", "2024-01-01", "2024-03-31"),
    ("YEARLY", "2024-01-01", "2024-12-31"), ("CUSTOM", None, None)])
def test_period_bounds(spark, kind, start, end):
    df = spark.createDataFrame([(kind, None, None)], "period_type string, start_date date, end_date date")
    want = (start and day(start), end and day(end))
    assert rows(filters.period_bounds(df, day("2024-02-15")).select("period_start", "period_end")) == [want]
    assert rows(filters.budget_default_dates(df, day("2024-02-15")).select("start_date", "end_date")) == [want]


def test_pages_are_the_same_on_both_ways(spark, small, monkeypatch):
    # ids far apart, so that a day holds several id blocks
    many = small.transactions(*[(i * 9000, 1 if i % 3 else 2, "OUTCOME", 1, f"2024-01-{i % 5 + 1:02d}") for i in range(120)])
    want = {}
    for user in (1, 2):
        mine = sorted((r for r in many.collect() if r.user_id == user), key=lambda r: (r.date, r.id), reverse=True)
        want[user] = [r.id for r in mine]
    for limit in (1000, 0):
        monkeypatch.setattr(sorting, "GROUP_LIMIT", limit)
        for page in (1, 3, 4):
            got = sorting.transaction_page(many, page, 20).orderBy("user_id", "position")
            for user in (1, 2):
                mine = [r for r in got.collect() if r.user_id == user]
                assert [r.id for r in mine] == want[user][(page - 1) * 20:page * 20]
                assert [r.position for r in mine] == list(range((page - 1) * 20 + 1, (page - 1) * 20 + 1 + len(mine)))


def test_pages_hold_rows_without_a_date_on_both_ways(spark, small, monkeypatch):
    some = small.transactions(*[(i, 1, "OUTCOME", 1, "2024-01-01") for i in range(1, 9)])
    some = some.withColumn("date", F.when(F.col("id") % 2 == 0, F.col("date")))
    for limit in (1000, 0):
        monkeypatch.setattr(sorting, "GROUP_LIMIT", limit)
        pages = [[r.id for r in sorting.transaction_page(some, page, 3).orderBy("position").collect()] for page in (1, 2, 3)]
        assert pages == [[8, 6, 4], [2, 7, 5], [3, 1]]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a" * 20, day("2024-09-05")), ("b" * 21, day("2024-01-31")), (None, None)], "s string, d date")
    cut = [r[0] for r in rows(df.select(X.cut_text("s")))]
    assert cut == ["a" * 20, "b" * 19 + "…", None]
    assert [r[0] for r in rows(df.select(X.list_date("d")))] == ["Sept. 5, 2024", "Jan. 31, 2024", None]
    assert [r[0] for r in rows(df.select(X.short_date("d")))] == ["Sep 05, 2024", "Jan 31, 2024", None]
    assert [r[0] for r in rows(df.select(X.long_date("d")))] == ["September 05, 2024", "January 31, 2024", None]
    empty = spark.createDataFrame([("",), (None,), ("x",)], "s string")
    assert [r[0] for r in rows(empty.select(X.text_or("s", "-")))] == ["-", "-", "x"]
    assert rows(spark.range(1).select(X.fixed_text(F.lit(12.349), 1), X.fixed_text(F.lit(2), 2))) == [("12.3", "2.00")]


def test_labels(spark, small):
    from tallyframe import schema as S
    c = spark.createDataFrame([(1, "salary", "INCOME", True, None), (2, "salary", "INCOME", False, 5),
                               (3, "odd", "OUTCOME", True, None)], S.CATEGORY)
    assert [r[0] for r in rows(joins.category_labels(c).orderBy("id").select("label"))] == ["Salary", "salary", "odd"]
    assert joins.category_labels(c, "ru").orderBy("id").first().label == "Зарплата"


def test_ownership_check(t, small):
    accounts = small.accounts((10, 1, 0), (11, 2, 0), (20, 2, 0))
    got = dict(rows(joins.account_ownership_check(t, accounts).select("id", "account_ok")))
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_display_fallbacks(spark, t, small):
    from tallyframe.sources.ledger import currencies
    c = small.categories((1, "salary", "INCOME", None), (11, "shopping", "OUTCOME", None))
    u = spark.createDataFrame([(1, "a@b", 2), (2, "c@d", None)], "id long, email string, currency_id long")
    got = {r.id: r for r in joins.transaction_display(t, c, u, currencies(spark)).collect()}
    assert (got[1].category_text, got[1].amount_text, got[1].date_text) == ("Salary", "10.00 EUR", "Jan. 1, 2024")
    assert (got[2].category_text, got[3].description_text, got[4].amount_text) == ("None", "None", "8.00 ")
    assert money(1) == money("1.00")
