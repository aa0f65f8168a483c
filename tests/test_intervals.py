import datetime as dt
import random

from ledger_rows import day, money, rows
from pyspark.sql import functions as F

from tallyframe.operators import filters, joins
from tallyframe.plans.intervals import interval_cells, interval_totals


def _days(grain, cell):
    if grain == "D":
        return [cell]
    end = dt.date(cell.year + (cell.month == 12 or grain == "Y"), 1 if grain == "Y" else cell.month % 12 + 1, 1)
    return [cell + dt.timedelta(n) for n in range((end - cell).days)]


def test_cells_cover_each_day_of_an_interval_once(spark):
    rng = random.Random(5)
    spans = [(day("2024-01-01"), day("2024-12-31")), (day("2024-02-29"), day("2024-02-29")),
             (day("2023-12-31"), day("2025-01-01")), (day("2024-01-05"), day("2024-01-20")),
             (day("2024-01-01"), day("2024-01-31")), (day("2024-01-02"), day("2024-03-31"))]
    for _ in range(300):
        s = day("2019-01-01") + dt.timedelta(rng.randrange(2000))
        spans.append((s, s + dt.timedelta(rng.choice([0, 1, 30, 31, 89, 364, 365, 800, rng.randrange(1500)]))))
    df = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(spans)], "id int, s date, e date")
    got = {}
    cells = interval_cells(df, "s", "e").select("id", "grain", "cell").collect()
    for i, grain, cell in cells:
        got.setdefault(i, []).extend(_days(grain, cell))
    for i, (s, e) in enumerate(spans):
        assert sorted(got[i]) == [s + dt.timedelta(n) for n in range((e - s).days + 1)], (s, e)
    # A calendar year is one cell, a month one, a quarter three.
    assert sum(1 for c in cells if c[0] == 0) == 1
    assert sum(1 for c in cells if c[0] == 4) == 1


def test_totals_equal_the_row_level_range_join_with_a_hot_user(spark, small):
    rng = random.Random(9)
    facts = [(i, 1 if i % 3 else rng.randrange(2, 20), "OUTCOME", rng.randrange(1, 100),
              (day("2021-01-01") + dt.timedelta(rng.randrange(900))).isoformat(), rng.choice([11, 12]))
             for i in range(1500)]
    t = small.transactions(*facts)
    spans = []
    for i in range(60):
        s = day("2021-01-01") + dt.timedelta(rng.randrange(700))
        spans.append((i, rng.randrange(1, 20), s.isoformat(), (s + dt.timedelta(rng.randrange(500))).isoformat(), None))
    b = small.budgets(*spans)
    got = interval_totals(b.withColumnRenamed("id", "budget_id"), "budget_id", "start_date", "end_date", t,
                          ["user_id"], {"spent": F.col("amount")}, ["category_id"])
    want = {}
    for i, u, s, e, _ in spans:
        for _, fu, _, a, d, c in facts:
            if fu == u and s <= d <= e:
                want[i, c] = want.get((i, c), 0) + a
    found = {(i, c): v for i, c, v in rows(got.select("budget_id", "category_id", "spent"))}
    assert {k: v for k, v in found.items() if k[1] is not None} == {k: money(v) for k, v in want.items()}
    assert {k[0] for k in found} == {i for i, *_ in spans}
    pairs = filters.budget_matches(b, t).select("budget_id", "id")
    brute = {(i, f[0]) for i, u, s, e, _ in spans for f in facts if f[1] == u and s <= f[4] <= e}
    found = rows(pairs)
    assert len(found) == len(brute) and set(found) == brute
    left = rows(joins.budget_transaction_join(b, t).select("budget_id", "transaction_id"))
    idle = {(i, None) for i, *_ in spans if not any(p[0] == i for p in brute)}
    assert len(left) == len(brute) + len(idle) and set(left) == brute | idle
