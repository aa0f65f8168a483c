"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.functions import scalars as X
from tallyframe.functions import sql
from tallyframe.operators import (
    balances,
    creation,
    filters,
    history,
    joins,
    mutations,
    quality,
    recurring,
    reports,
    sorting,
    stats,
)
from tallyframe.plans import dashboard
from tallyframe.plans.ids import largest_id, with_new_ids
from tallyframe.plans.keys import shuffled
from tallyframe.session import shared_dir
from tallyframe.sources import generate, ledger, seeds, sinks, versions
from tallyframe.streaming import ledger_streams, nightly

AS_OF = dt.date(1998, 6, 1)
EVENTS_AS_OF = dt.date(2024, 1, 30)
NOW = dt.datetime(2024, 2, 1)
USER = 44

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _ledger(spark: SparkSession, d: str) -> ledger.Ledger:
    return ledger.load(spark, d)


def _stored(L: ledger.Ledger) -> DataFrame:
    return balances.stored_accounts(L["accounts"], L["transactions"])


# --- sources and sinks ---------------------------------------------------------

@query
def q_scan_ledger(spark, d):
    return _ledger(spark, d)["transactions"]


@query
def q_seed_dimensions(spark, d):
    return seeds.seed_categories(spark, _ledger(spark, d)["categories"])


@query
def q_seed_currencies(spark, d):
    """Complete the currencies that users with an INCOME template hold."""
    L = _ledger(spark, d)
    earning = L["recurring"].filter(F.col("type") == S.INCOME).select(F.col("user_id").alias("id"))
    held = L["users"].join(earning, "id", "left_semi").select(F.col("currency_id").alias("id")).distinct()
    existing = L["currencies"].join(held, "id", "left_semi")
    return seeds.seed_currencies(spark, existing, by_name=True)


@query
def q_reset_system_categories(spark, d):
    return seeds.reset_system_categories(spark, _ledger(spark, d)["categories"])


@query
def q_generate_transactions(spark, d):
    L = _ledger(spark, d)
    return generate.generate_transactions(L["users"], L["accounts"], L["categories"], 50, EVENTS_AS_OF)


@query
def q_generate_transactions_table(spark, d):
    """The generated rows as they are added to the stored table, with ids above its own."""
    L = _ledger(spark, d)
    made = generate.generate_transactions(L["users"], L["accounts"], L["categories"], 50, EVENTS_AS_OF)
    return with_new_ids(made, ["user_id", "row_no"], largest_id(L["transactions"])).select(*L["transactions"].columns)


@query
def q_append_transactions_once(spark, d):
    """A store of the older rows, to which the newer ones are appended by a run that is repeated."""
    L, root = _ledger(spark, d), shared_dir(spark, "store")
    late = F.col("date") >= F.lit(dt.date(1997, 1, 1))
    versions.commit(spark, root, replace={"transactions": L["transactions"].filter(~late)})
    for _ in range(2):
        versions.commit(spark, root, append={"transactions": L["transactions"].filter(late)}, run_id="load-1997")
    return versions.read(spark, root)["transactions"]


@query
def q_versioned_changes(spark, d):
    """Row counts of every version while budgets and their limits are deleted, one commit each."""
    L, root = _ledger(spark, d), shared_dir(spark, "store")
    versions.commit(spark, root, replace={n: L[n] for n in ("transactions", "budgets", "limits", "categories")})
    for condition in ("total_expense_limit IS NULL", "name = 'budget_1997'"):
        now = versions.read(spark, root)
        asked = now["budgets"].filter(condition).select("id", "user_id")
        budgets, limits, _ = mutations.delete_budgets_cascade(now["budgets"], now["limits"], asked)
        versions.commit(spark, root, replace={"budgets": budgets, "limits": limits})
    return reduce_union([
        versions.read(spark, root, v)[n].groupBy(F.lit(v).cast("long").alias("version"), F.lit(n).alias("table_name")).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("id").cast("long").alias("id_sum"))
        for v in (1, 2, 3) for n in ("transactions", "budgets", "limits", "categories")
    ])


@query
def q_append_transactions(spark, d):
    path = shared_dir(spark, "facts")
    sinks.append_transactions(_ledger(spark, d)["transactions"], path)
    return spark.read.parquet(path)


@query
def q_export_transactions_json(spark, d):
    return sinks.export_transactions_json(_ledger(spark, d)["transactions"])


@query
def q_export_categories_json(spark, d):
    return sinks.export_categories_json(_ledger(spark, d)["categories"])


@query
def q_chart_series(spark, d):
    series = stats.chart_series(_ledger(spark, d)["transactions"])

    def text(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: x.cast("decimal(26,2)").cast("string")), ",").alias(c)

    return series.select("user_id", F.array_join("labels", ",").alias("labels"), text("income_data"), text("expense_data"))


# --- filters and projections -----------------------------------------------------

@query
def q_filter_by_user(spark, d):
    return filters.filter_by_user(_ledger(spark, d)["transactions"], USER)


@query
def q_filter_by_account(spark, d):
    L = _ledger(spark, d)
    return filters.filter_by_account(L["transactions"], USER * 3 + 1, L["accounts"], USER)


@query
def q_filter_by_type(spark, d):
    return filters.filter_by_type(_ledger(spark, d)["transactions"], S.INCOME)


@query
def q_filter_by_category(spark, d):
    return filters.filter_by_category(_ledger(spark, d)["transactions"], filters.OTHER)


@query
def q_filter_by_date_range(spark, d):
    return filters.filter_by_date_range(
        _ledger(spark, d)["transactions"], dt.date(1997, 1, 1), dt.date(1997, 12, 31)
    )


@query
def q_filter_by_description(spark, d):
    return filters.filter_by_description(_ledger(spark, d)["transactions"], "Urgent")


@query
def q_transaction_search(spark, d):
    return filters.transaction_search(
        _ledger(spark, d)["transactions"], kind=S.OUTCOME, category=11,
        date_from=dt.date(1996, 1, 1), date_to=dt.date(1999, 12, 31), description="1-urgent",
    )


@query
def q_visible_categories(spark, d):
    return filters.visible_categories(_ledger(spark, d)["categories"], USER, S.OUTCOME)


@query
def q_categories_by_type(spark, d):
    return filters.categories_by_type(_ledger(spark, d)["categories"], S.OUTCOME)


@query
def q_active_accounts(spark, d):
    return filters.active_accounts(_ledger(spark, d)["accounts"])


@query
def q_budget_transactions(spark, d):
    L = _ledger(spark, d)
    return joins.budget_transactions(L["budgets"], L["transactions"], L["categories"], L["accounts"])


@query
def q_current_budget_candidates(spark, d):
    return filters.overlapping_budgets(_ledger(spark, d)["budgets"], *dashboard.window_of(AS_OF))


@query
def q_recurring_due(spark, d):
    return recurring.recurring_due(_ledger(spark, d)["recurring"], AS_OF)


@query
def q_recurring_due_range(spark, d):
    return recurring.recurring_due_range(_ledger(spark, d)["recurring"], dt.date(1998, 5, 20), AS_OF).select(
        "id", "date", "frequency"
    )


@query
def q_signed_amount(spark, d):
    return filters.with_signed_amount(_ledger(spark, d)["transactions"]).select("id", "type", "amount", "signed_amount")


def _budget_drafts(L: ledger.Ledger) -> DataFrame:
    """Budgets with mixed period types, some without a start or an end."""
    kind = F.element_at(F.array(*[F.lit(k) for k in S.ENUMS["period_type"]]), (F.year("start_date") % 4 + 1).cast("int"))
    return L["budgets"].withColumns({
        "period_type": kind,
        "start_date": F.when(F.col("total_expense_limit").isNotNull(), F.col("start_date")),
        "end_date": F.when(F.col("is_active"), F.col("end_date")),
    })


@query
def q_period_bounds(spark, d):
    drafts = _budget_drafts(_ledger(spark, d))
    return filters.period_bounds(drafts, AS_OF).select("id", "period_type", "period_start", "period_end")


@query
def q_budget_default_dates(spark, d):
    drafts = _budget_drafts(_ledger(spark, d))
    return filters.budget_default_dates(drafts, AS_OF).select("id", "period_type", "start_date", "end_date")


@query
def q_transaction_display(spark, d):
    L = _ledger(spark, d)
    return joins.transaction_display(L["transactions"], L["categories"], L["users"], L["currencies"])


# --- joins ---------------------------------------------------------------------------

@query
def q_user_category_matrix(spark, d):
    L = _ledger(spark, d)
    return joins.user_category_matrix(L["users"], L["categories"])


@query
def q_budget_transaction_join(spark, d):
    L = _ledger(spark, d)
    return joins.budget_transaction_join(L["budgets"], L["transactions"])


@query
def q_recurring_antijoin(spark, d):
    L = _ledger(spark, d)
    due = recurring.recurring_due(L["recurring"], AS_OF)
    # What an earlier run of the job stored for the monthly templates.
    earlier = due.filter("frequency = 'monthly'").select(
        "id", "user_id", "type", "amount", "date", "description", "category_id", "account_id"
    )
    existing = L["transactions"].unionByName(earlier)
    return recurring.recurring_antijoin(due, existing, AS_OF, AS_OF).select(
        "id", "user_id", "account_id", "amount", "type", "category_id", "date"
    )


@query
def q_budget_categories(spark, d):
    L = _ledger(spark, d)
    return joins.budget_categories(L["categories"], L["limits"])


@query
def q_transaction_enriched(spark, d):
    L = _ledger(spark, d)
    return joins.transaction_enriched(L["transactions"], L["categories"], L["accounts"], L["users"])


@query
def q_category_labels(spark, d):
    return joins.category_labels(_ledger(spark, d)["categories"], "ru")


@query
def q_heatmap_grid(spark, d):
    return stats.heatmap_grid(ledger.event_transactions(spark, d))


@query
def q_account_ownership_check(spark, d):
    L = _ledger(spark, d)
    return joins.account_ownership_check(ledger.raw_transactions(spark, d), L["accounts"]).select("id", "account_ok")


@query
def q_user_currency(spark, d):
    L = _ledger(spark, d)
    return joins.user_currency(L["users"], L["currencies"])


# --- reports and aggregations -----------------------------------------------------

@query
def q_monthly_income_expense(spark, d):
    L = _ledger(spark, d)
    return reports.monthly_income_expense(L["users"], L["transactions"])


@query
def q_category_report(spark, d):
    L = _ledger(spark, d)
    return reports.category_report(L["users"], L["categories"], L["transactions"])


@query
def q_account_balance_report(spark, d):
    L = _ledger(spark, d)
    return reports.account_balance_report(_stored(L), L["users"], L["currencies"], L["transactions"])


@query
def q_budget_execution(spark, d):
    L = _ledger(spark, d)
    return reports.budget_execution(L["budgets"], L["users"], L["transactions"])


@query
def q_budget_limit_check(spark, d):
    L = _ledger(spark, d)
    return reports.budget_limit_check(L["limits"], L["budgets"], L["categories"], L["transactions"]).drop(
        "category_is_system"
    )


@query
def q_period_totals(spark, d):
    return stats.period_totals(ledger.event_transactions(spark, d))


@query
def q_daily_income_expense(spark, d):
    return stats.daily_income_expense(_ledger(spark, d)["transactions"])


@query
def q_expense_by_category(spark, d):
    L = _ledger(spark, d)
    return stats.expense_by_category(L["transactions"], L["categories"])


@query
def q_expense_frequency(spark, d):
    L = _ledger(spark, d)
    return stats.expense_frequency(L["transactions"], L["categories"], "ru")


@query
def q_expense_heatmap(spark, d):
    return stats.expense_heatmap(_ledger(spark, d)["transactions"])


@query
def q_expense_heatmap_week_of_year(spark, d):
    return stats.expense_heatmap(_ledger(spark, d)["transactions"], "week_of_year")


@query
def q_heatmap_week_labels(spark, d):
    return stats.heatmap_week_labels(ledger.event_transactions(spark, d))


@query
def q_sql_balance_on_date(spark, d):
    sql.register(spark, _ledger(spark, d))
    return spark.sql(f"SELECT id AS account_id, ledger_balance_on_date(id, DATE '{AS_OF}') AS balance FROM ledger_accounts")


@query
def q_sql_limit_check(spark, d):
    sql.register(spark, _ledger(spark, d))
    return spark.sql("SELECT c.* FROM ledger_budgets b, LATERAL ledger_limit_check(b.id) c")


@query
def q_total_active_balance(spark, d):
    L = _ledger(spark, d)
    return balances.total_active_balance(L["users"], _stored(L))


@query
def q_budget_progress(spark, d):
    L = _ledger(spark, d)
    return reports.budget_progress(L["budgets"], L["transactions"])


@query
def q_category_limit_progress(spark, d):
    L = _ledger(spark, d)
    return reports.category_limit_progress(L["limits"], L["budgets"], L["transactions"])


@query
def q_recompute_balances(spark, d):
    L = _ledger(spark, d)
    return balances.recompute_balances(L["accounts"], L["transactions"])


@query
def q_balance_on_date(spark, d):
    L = _ledger(spark, d)
    return balances.balance_on_date(L["accounts"], L["transactions"], AS_OF)


@query
def q_balance_at_requests(spark, d):
    """Month-end statements for every account and month with rows."""
    L = _ledger(spark, d)
    requests = L["transactions"].filter("account_id IS NOT NULL").select(
        "account_id", F.last_day("date").alias("date")
    )
    return balances.balance_at_requests(L["accounts"], L["transactions"], requests)


@query
def q_account_transaction_counts(spark, d):
    L = _ledger(spark, d)
    return reports.account_transaction_counts(L["accounts"], L["transactions"])


@query
def q_account_detail_totals(spark, d):
    L = _ledger(spark, d)
    return reports.account_detail_totals(L["accounts"], L["transactions"])


@query
def q_dashboard_summary(spark, d):
    L = _ledger(spark, d)
    return dashboard.dashboard_summary(L["users"], L["budgets"], L["transactions"], _stored(L), AS_OF)


@query
def q_dashboard_limit_lines(spark, d):
    L = _ledger(spark, d)
    return dashboard.dashboard_limit_lines(L["budgets"], L["limits"], L["categories"], L["transactions"], AS_OF)


@query
def q_stats_bundle(spark, d):
    L = _ledger(spark, d)
    rows = filters.filter_by_date_range(L["transactions"], dt.date(1996, 1, 1), dt.date(1998, 12, 31))
    return stats.stats_bundle(rows, L["categories"])


# --- windows, orders, sets ----------------------------------------------------------

@query
def q_current_budget(spark, d):
    return dashboard.current_budget(_ledger(spark, d)["budgets"], AS_OF)


@query
def q_running_balance(spark, d):
    L = _ledger(spark, d)
    return balances.running_balance(L["accounts"], L["transactions"])


@query
def q_transaction_page(spark, d):
    return sorting.transaction_page(_ledger(spark, d)["transactions"], page=2, page_size=5)


@query
def q_sort_transactions(spark, d):
    return sorting.sort_transactions(_ledger(spark, d)["transactions"], "-amount").select("id", "amount", "date")


@query
def q_recent_transactions(spark, d):
    return sorting.recent_transactions(_ledger(spark, d)["transactions"])


@query
def q_account_list(spark, d):
    return sorting.account_list(_ledger(spark, d)["accounts"]).select(
        "id", "user_id", "name", "account_type_label", "initial_balance", "is_active"
    )


@query
def q_budget_list(spark, d):
    return sorting.budget_list(_ledger(spark, d)["budgets"])


@query
def q_recurring_list(spark, d):
    L = _ledger(spark, d)
    return recurring.recurring_list(L["recurring"], L["categories"])


@query
def q_day_labels(spark, d):
    return stats.day_labels(_ledger(spark, d)["transactions"])


@query
def q_scalar_functions(spark, d):
    t = _ledger(spark, d)["transactions"]
    return t.select(
        "id",
        X.month_of("date").alias("month"),
        X.iso_year("date").alias("iso_year"),
        F.weekofyear("date").alias("week"),
        F.weekday("date").alias("weekday_num"),
        F.date_format("date", "EEEE").alias("weekday"),
        X.week_label(X.monday_of("date")).alias("week_label"),
        X.short_date("date").alias("short_date"),
        X.long_date("date").alias("long_date"),
        X.list_date("date").alias("list_date"),
        X.cut_text("description", 10).alias("cut"),
        X.text_or("description", "-").alias("description_or_dash"),
        X.contains_text("description", "HIGH").alias("has_high"),
        X.signed_amount().alias("signed_amount"),
        X.fixed_text(F.col("amount") / 1000, 1).alias("thousands_text"),
        X.clamp_percent(F.col("amount").cast("double") / 1000).alias("clamped"),
        F.date_sub("date", 30).alias("window_start"),
        X.period_end(F.lit("QUARTERLY"), "date").alias("quarter_end"),
    )


# --- table changes -------------------------------------------------------------------

def _ingest(spark, d):
    L = _ledger(spark, d)
    return mutations.ingest_transactions(
        L["transactions"].filter("false"), _stored(L), ledger.raw_transactions(spark, d), NOW
    )


@query
def q_ingest_transactions(spark, d):
    return _ingest(spark, d)[2]


@query
def q_ingest_transactions_balances(spark, d):
    return _ingest(spark, d)[1].select("id", "balance", "updated_at")


def _create_transactions(spark, d):
    """Every raw row is asked for again as a new one, some without an amount or a date or on an unknown category."""
    L = _ledger(spark, d)
    requests = ledger.raw_transactions(spark, d).select(
        F.col("id").alias("request_id"), "user_id", "type",
        F.when(F.col("id") % 53 != 0, F.col("amount")).alias("amount"), F.when(F.col("id") % 59 != 0, F.col("date")).alias("date"),
        "description", F.when(F.col("id") % 61 == 0, F.lit(999).cast("long")).otherwise(F.col("category_id")).alias("category_id"),
        "account_id")
    return L, *mutations.create_transactions(L["transactions"], _stored(L), L["categories"], requests, NOW)


@query
def q_ingest_transactions_table(spark, d):
    L, new, _, _ = _create_transactions(spark, d)
    return L["transactions"].unionByName(new)


@query
def q_ingest_transactions_requests(spark, d):
    return _create_transactions(spark, d)[3]


@query
def q_ingest_transactions_new_balances(spark, d):
    return _create_transactions(spark, d)[2].select("id", "balance", "updated_at")


@query
def q_ingest_transactions_refused(spark, d):
    """Raw rows with their own ids against a store that holds the even ones; odd multiples of 77 come twice."""
    L = _ledger(spark, d)
    raw = ledger.raw_transactions(spark, d)
    batch = raw.unionByName(raw.filter("id % 154 = 77"))
    out, _, report = mutations.ingest_transactions(L["transactions"].filter("id % 2 = 0"), _stored(L), batch, NOW, L["categories"])
    return report.join(out.select("id", F.lit(True).alias("is_stored")), "id", "left").select(
        "id", "status", "reason", F.coalesce("is_stored", F.lit(False)).alias("is_stored"))


def _create_categories(spark, d):
    """Each user asks for a used name, a new one, the same again, a blank one and a wrong type."""
    L = _ledger(spark, d)
    asked = F.posexplode(F.array(*[F.struct(n.alias("name"), F.lit(k).alias("type")) for n, k in (
        (F.lit("machinery"), S.OUTCOME), (F.lit(" pets "), S.OUTCOME), (F.lit("pets"), S.INCOME), (F.lit("  "), S.INCOME),
        (F.concat(F.lit("gifts "), F.col("id") % 7), "TRANSFER"))])).alias("_no", "_asked")
    batch = L["users"].select("id", asked).select(
        (F.col("id") * 10 + F.col("_no")).alias("request_id"), F.col("id").alias("user_id"), "_asked.name", "_asked.type")
    return L, *creation.create_categories(L["categories"], batch)


@query
def q_create_categories(spark, d):
    L, new, _ = _create_categories(spark, d)
    return L["categories"].unionByName(new)


@query
def q_create_categories_report(spark, d):
    return _create_categories(spark, d)[2]


def _create_recurring(spark, d):
    """Every account asks for a template; types, amounts, categories and askers are partly wrong."""
    L = _ledger(spark, d)
    no = F.col("id")
    batch = L["accounts"].select(
        no.alias("request_id"), F.when(no % 13 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(no % 17 != 0, no).alias("account_id"), F.when(no % 19 != 0, F.lit(25)).cast(S.MONEY).alias("amount"),
        F.when(no % 23 == 0, S.INCOME).otherwise(S.OUTCOME).alias("type"),
        F.when(no % 5 == 0, F.col("user_id") + 1000).when(no % 5 != 1, F.lit(11)).cast("long").alias("category_id"),
        F.lit("plan").alias("description"),
        F.when(no % 29 == 0, "hourly").otherwise("monthly").alias("frequency"),
        F.when(no % 31 != 0, F.lit(dt.date(1998, 1, 31))).alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return L, *creation.create_recurring(L["recurring"], L["accounts"], L["categories"], batch)


@query
def q_create_recurring(spark, d):
    L, new, _ = _create_recurring(spark, d)
    return L["recurring"].unionByName(new)


@query
def q_create_recurring_report(spark, d):
    return _create_recurring(spark, d)[2]


def _delete_transactions(spark, d):
    """Requests for every row without a category, those on expenses by a wrong user."""
    L = _ledger(spark, d)
    asker = F.when(F.col("type") == S.INCOME, F.col("user_id")).otherwise(F.col("user_id") + 1)
    requests = L["transactions"].filter("category_id IS NULL AND user_id IS NOT NULL").select(
        "id", asker.alias("user_id")
    )
    return mutations.delete_transactions(L["transactions"], _stored(L), requests)


@query
def q_delete_transactions(spark, d):
    return _delete_transactions(spark, d)[2]


@query
def q_delete_transactions_balances(spark, d):
    return _delete_transactions(spark, d)[1].select("id", "balance")


def _close_budgets(spark, d):
    L = _ledger(spark, d)
    known = L["budgets"].filter("name = 'budget_1997'").select("id")
    unknown = L["budgets"].filter("total_expense_limit IS NULL").select((-F.col("id") - 1).alias("id"))
    return mutations.close_budgets(L["budgets"], known.unionByName(unknown))


@query
def q_close_budgets(spark, d):
    return _close_budgets(spark, d)[1]


@query
def q_close_budgets_state(spark, d):
    return _close_budgets(spark, d)[0].select("id", "is_active")


@query
def q_delete_accounts_guarded(spark, d):
    L = _ledger(spark, d)
    return mutations.delete_accounts_guarded(
        L["accounts"], L["transactions"], L["recurring"], L["accounts"].select("id", "user_id")
    )[2]


def _delete_categories(spark, d, recompute=False):
    """Owners delete their machinery and furniture categories; the others are asked for by strangers."""
    L = _ledger(spark, d)
    L = L.replaced(accounts=_stored(L))
    asker = F.when(F.col("name").isin("machinery", "furniture"), F.col("user_id")).otherwise(F.col("user_id") + 1)
    requests = L["categories"].filter("NOT is_system").select("id", asker.alias("user_id"))
    return L, *mutations.delete_categories_cascade(L, requests, recompute)


@query
def q_delete_categories_cascade(spark, d):
    _, out, _ = _delete_categories(spark, d)
    return reduce_union([
        out[n].select(F.lit(n).alias("table_name"), "id", "category_id") for n in ("transactions", "limits", "recurring")
    ])


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first


@query
def q_delete_budgets_cascade(spark, d):
    L = _ledger(spark, d)
    requests = L["budgets"].filter("total_expense_limit IS NULL").select("id", "user_id")
    budgets, limits, _ = mutations.delete_budgets_cascade(L["budgets"], L["limits"], requests)
    return reduce_union([
        budgets.select(F.lit("budgets").alias("table_name"), "id"),
        limits.select(F.lit("limits").alias("table_name"), "id"),
    ])


@query
def q_delete_users_cascade(spark, d):
    L = _ledger(spark, d)
    out, _ = mutations.delete_users_cascade(L, L["users"].filter("currency_id IS NULL").select("id"))
    tables = ("users", "categories", "accounts", "transactions", "recurring", "budgets", "limits")
    return reduce_union([out[n].select(F.lit(n).alias("table_name"), "id") for n in tables])


def _open_accounts(spark, d):
    """Two new accounts per user; a taken name and a twin are among them."""
    L = _ledger(spark, d)
    def batch(offset: int, name: Column) -> DataFrame:
        return L["users"].select(
            (F.col("id") + offset).alias("id"), name.alias("name"), F.lit("SAVINGS").alias("account_type"),
            (F.col("id") % 100).cast(S.MONEY).alias("initial_balance"), F.col("id").alias("user_id"),
        )
    first = batch(10_000_000, F.when(F.col("currency_id").isNull(), "acct_1").otherwise("savings"))
    second = batch(20_000_000, F.lit("savings"))
    return mutations.open_accounts(_stored(L), first.unionByName(second), NOW)


@query
def q_open_accounts(spark, d):
    return _open_accounts(spark, d)[0].select(
        "id", "name", "account_type", "balance", "initial_balance", "is_active", "user_id"
    )


@query
def q_open_accounts_report(spark, d):
    return _open_accounts(spark, d)[1]


@query
def q_upsert_accounts(spark, d):
    """Every account is renamed or retyped; edits of inactive ones come from a stranger."""
    accounts = _ledger(spark, d)["accounts"]
    edits = accounts.select(
        "id",
        F.when(F.col("is_active"), F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"),
        F.when(F.col("account_type") == "BANK", "").otherwise(F.concat("name", F.lit("_new"))).alias("name"),
        F.when(F.col("account_type") == "CASH", "WALLET").otherwise("").alias("account_type"),
    )
    changed, _ = mutations.upsert_accounts(accounts, edits)
    return changed.select("id", "name", "account_type", "user_id", "is_active")


def _upsert_budgets(spark, d):
    """Budgets of 1999 are edited (without a limit: to bad dates), each user gets a new one."""
    L = _ledger(spark, d)
    edits = L["budgets"].filter("name = 'budget_1999'").select(
        "id", "user_id", F.concat("name", F.lit("_edit")).alias("name"), F.lit("MONTHLY").alias("period_type"),
        "start_date",
        F.when(F.col("total_expense_limit").isNull(), F.col("start_date")).otherwise(F.last_day("start_date")).alias("end_date"),
        (F.col("total_expense_limit") + 100).cast(S.MONEY).alias("total_expense_limit"),
    )
    new = L["users"].select(
        (F.col("id") + 1_000_000_000).alias("id"), F.col("id").alias("user_id"), F.lit("holiday").alias("name"),
        F.lit("CUSTOM").alias("period_type"), F.lit(dt.date(2002, 7, 1)).alias("start_date"),
        F.lit(dt.date(2002, 8, 15)).alias("end_date"), F.lit(500).cast(S.MONEY).alias("total_expense_limit"),
    )
    limit_edits = L["limits"].filter("category_id IN (11, 12)").select(
        "id", "budget_id", "category_id", (F.col("limit_amount") + 1).cast(S.MONEY).alias("limit_amount"),
        (F.col("category_id") == 12).alias("is_deleted"),
    )
    new_limits = L["users"].select(
        (F.col("id") + 9_000_000_000).alias("id"), (F.col("id") + 1_000_000_000).alias("budget_id"),
        F.lit(11).cast("long").alias("category_id"), F.lit(50).cast(S.MONEY).alias("limit_amount"),
        F.lit(False).alias("is_deleted"),
    )
    return mutations.upsert_budgets(
        L["budgets"], L["limits"], edits.unionByName(new), limit_edits.unionByName(new_limits)
    )


@query
def q_upsert_budgets(spark, d):
    return _upsert_budgets(spark, d)[0]


@query
def q_upsert_budgets_limits(spark, d):
    return _upsert_budgets(spark, d)[1]


def _upsert_limits(spark, d):
    """Edits of every limit: own and foreign, on income and unknown categories, moved onto another limit, deleted, twice."""
    L = _ledger(spark, d)
    owners = L["budgets"].select(F.col("id").alias("budget_id"), "user_id")
    no = F.col("id")
    edits = L["limits"].join(shuffled(owners), "budget_id").select(
        "id",
        F.when(no % 7 == 0, F.col("budget_id") + 5_000_000).when(no % 11 == 0, F.col("budget_id") + 1).otherwise(F.col("budget_id")).alias("budget_id"),
        F.when(no % 5 == 0, F.lit(1)).when(no % 3 == 0, F.lit(12)).otherwise(F.col("category_id")).cast("long").alias("category_id"),
        F.when(no % 13 != 0, F.col("limit_amount") + 1).cast(S.MONEY).alias("limit_amount"),
        ((F.col("category_id") == 12) & (F.col("budget_id") % 2 == 0)).alias("is_deleted"),
        F.when(no % 17 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    times = F.explode(F.when(no % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")
    return mutations.upsert_limits(L["limits"], L["budgets"], L["categories"], edits.select("*", times).drop("_time"))


@query
def q_upsert_limits(spark, d):
    return _upsert_limits(spark, d)[0]


@query
def q_upsert_limits_report(spark, d):
    return _upsert_limits(spark, d)[1]


def _nightly_store(spark, d):
    """A store on which the job runs for four days and then for a range that overlaps them."""
    L, root = _ledger(spark, d), shared_dir(spark, "store")
    tables = {n: L[n] for n in ("transactions", "categories", "recurring")}
    versions.commit(spark, root, replace=tables | {"accounts": _stored(L)})
    nightly.commit_nightly(spark, root, dt.date(1998, 5, 24), dt.date(1998, 5, 28))
    return root, nightly.commit_nightly(spark, root, dt.date(1998, 5, 26), AS_OF)


@query
def q_materialize_recurring_table(spark, d):
    """The stored rows after two overlapping runs."""
    root, _ = _nightly_store(spark, d)
    return versions.read(spark, root)["transactions"].drop("month")


@query
def q_materialize_recurring_days(spark, d):
    """Created counts of the second run's days."""
    return _nightly_store(spark, d)[1]


@query
def q_materialize_recurring_accounts(spark, d):
    root, _ = _nightly_store(spark, d)
    return versions.read(spark, root)["accounts"].select("id", "balance")


@query
def q_materialize_recurring(spark, d):
    L = _ledger(spark, d)
    return recurring.materialize_recurring(L["recurring"], L["categories"], L["transactions"], AS_OF)


@query
def q_materialize_recurring_balances(spark, d):
    L = _ledger(spark, d)
    created = recurring.materialize_recurring(L["recurring"], L["categories"], L["transactions"], AS_OF)
    return recurring.apply_to_balances(_stored(L), created).select("id", "balance")


@query
def q_delete_recurring(spark, d):
    L = _ledger(spark, d)
    asker = F.when(F.col("description").isNotNull(), F.col("user_id")).otherwise(F.col("user_id") + 1)
    requests = L["recurring"].filter("end_date IS NOT NULL").select("id", asker.alias("user_id"))
    return mutations.delete_recurring(L["recurring"], requests)[0]


@query
def q_currency_delete_set_null(spark, d):
    L = _ledger(spark, d)
    requests = L["currencies"].filter("symbol IN ('EUR', 'GBP')").select("id")
    return mutations.currency_delete_set_null(L["users"], L["currencies"], requests)[0]


# --- data quality ------------------------------------------------------------------

@query
def q_check_enums(spark, d):
    return quality.check_enums(ledger.raw_transactions(spark, d), ["type"]).select("id", "type", "reason")


@query
def q_check_category_type(spark, d):
    L = _ledger(spark, d)
    return quality.check_category_type(ledger.raw_transactions(spark, d), L["categories"]).select("id", "reason")


@query
def q_check_budget_dates(spark, d):
    return quality.check_budget_dates(_budget_drafts(_ledger(spark, d))).select("id", "reason")


@query
def q_check_unique(spark, d):
    """(name, user) over candidate names that many rows repeat and some lack."""
    t = _ledger(spark, d)["transactions"].select("id", F.col("description").alias("name"), "user_id")
    return quality.check_unique(t, ["name", "user_id"])


@query
def q_check_references(spark, d):
    L = _ledger(spark, d)
    refs = {"account_id": filters.active_accounts(L["accounts"]), "category_id": L["categories"].filter("is_system")}
    return quality.check_references(L["transactions"], refs).select("id", "account_id", "category_id", "reason")


@query
def q_check_required(spark, d):
    t = _ledger(spark, d)["transactions"]
    return quality.check_required(t, ["user_id", "account_id", "amount", "date"], ["description"]).select("id", "reason")


@query
def q_check_ranges(spark, d):
    """Amounts on a scale where the larger ones no longer fit, descriptions of up to 13 characters."""
    t = _ledger(spark, d)["transactions"].withColumn(
        "amount", F.col("amount").cast("decimal(38,2)") * F.lit(1_000_000_000)
    )
    return quality.check_ranges(t, {"description": 13}, ["amount"]).select("id", "reason")


@query
def q_check_limit_categories(spark, d):
    """Per budget candidates on a system, an income and an own or foreign category."""
    L = _ledger(spark, d)
    user = F.col("user_id")
    wanted = F.posexplode(F.array(F.lit(11).cast("long"), F.lit(1).cast("long"), user - user % 4 + 1000))
    candidates = L["budgets"].select(F.col("id").alias("budget_id"), wanted.alias("_pos", "category_id")).select(
        (F.col("budget_id") * 10 + F.col("_pos")).alias("id"), "budget_id", "category_id"
    )
    return quality.check_limit_categories(candidates, L["budgets"], L["categories"])


@query
def q_balance_reconciliation(spark, d):
    """Stored balances after deleting categories without recomputation."""
    L, out, _ = _delete_categories(spark, d)
    return balances.balance_reconciliation(out["accounts"], out["transactions"])


# --- change history --------------------------------------------------------------------

def _account_snapshots(spark, d):
    L = _ledger(spark, d)
    old = L["accounts"]
    kept = old.filter("id % 17 <> 0").withColumn(
        "account_type", F.when(F.col("id") % 19 == 0, "WALLET").otherwise(F.col("account_type"))
    )
    added = old.filter("account_type = 'BANK' AND user_id % 23 = 0").withColumns({
        "id": F.col("user_id") + 10_000_000, "name": F.lit("acct_new"),
    })
    return old, kept.unionByName(added)


@query
def q_account_history(spark, d):
    return history.account_history(*_account_snapshots(spark, d), NOW)


@query
def q_budget_history(spark, d):
    budgets = _ledger(spark, d)["budgets"]
    kept = budgets.filter("name <> 'budget_1995'").withColumn(
        "is_active", F.col("is_active") & (F.col("name") != "budget_1996")
    )
    added = budgets.filter("name = 'budget_2001' AND total_expense_limit IS NULL").withColumn(
        "id", F.col("id") + 1_000_000_000
    )
    return history.budget_history(budgets, kept.unionByName(added), NOW, actor=3)


@query
def q_history_by_entity(spark, d):
    log = history.account_history(*_account_snapshots(spark, d), NOW)
    return history.history_by_entity(log, "account_id").select("account_id", "changed_at", "action", "changed_by")


# --- streams ------------------------------------------------------------------------

def _table_stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    return ledger_streams.file_stream(spark, d, ledger.INPUT_SCHEMAS[table], f"{table}.parquet")


@query
def q_stream_ingest_balances(spark, d):
    out = shared_dir(spark, "ingest")
    accounts = _ledger(spark, d)["accounts"]
    source = ledger.raw_transactions_of(_table_stream(spark, d, "orders"))
    ledger_streams.stream_ingest(source, accounts, out).awaitTermination()
    return ledger_streams.streamed_balances(spark, accounts, out)


@query
def q_stream_daily_stats(spark, d):
    out = shared_dir(spark, "daily")
    source = ledger.event_transactions_of(_table_stream(spark, d, "events"))
    ledger_streams.stream_daily_stats(source, out).awaitTermination()
    return ledger_streams.streamed_daily_stats(spark, out)


def event_changes_of(events: DataFrame) -> DataFrame:
    """Change stream: every event is entered, expenses are doubled and moved on a day, incomes below 50 are deleted."""
    image = F.struct("user_id", "type", "amount", "ts")
    later = F.struct(
        "user_id", "type", (F.col("amount") * 2).cast(S.MONEY).alias("amount"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))

    def change(old: Column, new: Column) -> Column:
        return F.struct(old.alias("old"), new.alias("new"))

    changes = F.array(
        change(F.when(F.lit(False), image), image),
        F.when(F.col("type") == S.OUTCOME, change(image, later)),
        F.when((F.col("type") == S.INCOME) & (F.col("amount") < 50), change(image, F.when(F.lit(False), image))))
    return ledger.event_transactions_of(events).select(F.explode(changes).alias("c")).select("c.old", "c.new")


@query
def q_stream_daily_changes(spark, d):
    out = shared_dir(spark, "daily-changes")
    ledger_streams.stream_daily_changes(event_changes_of(_table_stream(spark, d, "events")), out).awaitTermination()
    return ledger_streams.streamed_daily_stats(spark, out)


def account_changes_of(customer: DataFrame) -> DataFrame:
    """Change stream: every account opens, is retyped, and the inactive ones are deleted."""
    accounts = ledger.accounts_of(customer)
    image = X.row_json("id", "name", "account_type", "user_id")
    def change(seq: int, rows: DataFrame, shown: Column) -> DataFrame:
        return rows.select(
            F.lit(seq).cast("long").alias("seq"), F.col("id").alias("account_id"), "user_id", shown.alias("image")
        )
    opened = change(1, accounts, image)
    retyped = change(2, accounts.withColumn("account_type", F.lit("WALLET")), image)
    deleted = change(3, accounts.filter("NOT is_active"), F.lit(None).cast("string"))
    return opened.unionByName(retyped).unionByName(deleted)


@query
def q_stream_account_history(spark, d):
    out = shared_dir(spark, "history")
    source = account_changes_of(_table_stream(spark, d, "customer"))
    ledger_streams.stream_account_history(source, out).awaitTermination()
    return ledger_streams.streamed_history(spark, out)


@query
def q_recurring_nightly(spark, d):
    L = _ledger(spark, d)
    return nightly.recurring_nightly(
        L["recurring"], L["categories"], L["transactions"], dt.date(1998, 5, 24), AS_OF
    )
