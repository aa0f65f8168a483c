"""Table changes as DataFrame transforms.

Every operator takes the current tables and a batch of requests and returns
the changed tables and a report (id, status, reason). Nothing is overwritten
in place: write the returned frames to a new folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.operators.balances import with_account_totals
from tallyframe.operators.joins import account_ownership_check
from tallyframe.plans.ids import largest_id, with_new_ids
from tallyframe.plans.keys import anti_on_key, category_lookup, left_lookup, null_slot, shuffled
from tallyframe.schema import ENUMS, MONEY, OUTCOME, TOTAL
from tallyframe.session import written
from tallyframe.sources.ledger import Ledger

def _report(df: DataFrame, reason: Column, id_col: str = "id") -> DataFrame:
    return df.select(
        F.col(id_col).alias("id"), F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"),
        reason.alias("reason"),
    )


def _asked_and_found(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Requests (id, user_id) with ``_found``: one user's request says nothing about another's for the same id."""
    return asked.join(found.select("id", "user_id").distinct().withColumn("_found", F.lit(True)), ["id", "user_id"], "left")


def _repeated(df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with ``_times``: how many rows have the row's key."""
    return df.join(shuffled(df.groupBy(key).agg(F.count(F.lit(1)).alias("_times"))), key, "left")


# --- transactions ------------------------------------------------------------

def checked_transactions(batch: DataFrame, accounts: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """The batch with ``reason``: NULL when the row may be stored.

    Type, amount and date are required, an account must be the row's user's
    own, and a category, if ``categories`` are given, must exist.
    """
    spread = "request_id" if "request_id" in batch.columns else "id"
    rows = account_ownership_check(batch, accounts, spread)
    reason = F.when(~F.coalesce(F.col("type").isin(ENUMS["type"]), F.lit(False)), "invalid type").when(
        F.col("amount").isNull(), "amount required").when(F.col("date").isNull(), "date required").when(
        ~F.col("account_ok"), "account not found or access denied"
    )
    if categories is not None:
        rows = category_lookup(rows, categories, spread)
        reason = reason.when(F.col("category_id").isNotNull() & F.col("category_name").isNull(), "category not found")
    return rows.withColumn("reason", reason).select(*batch.columns, "reason")


def _with_changes(stored: DataFrame, rows: DataFrame, now: dt.datetime) -> DataFrame:
    """Stored accounts with the signed sums of ``rows`` added; accounts with rows are marked as changed ``now``."""
    change = rows.filter("account_id IS NOT NULL").groupBy("account_id").agg(F.sum(X.signed_amount()).alias("_change"))
    touched = F.col("account_id").isNotNull()
    return (
        stored.join(change, stored["id"] == change["account_id"], "left")
        .withColumns({
            "balance": (F.col("balance") + F.coalesce("_change", F.lit(0))).cast(TOTAL),
            "updated_at": F.when(touched, F.lit(now)).otherwise(F.col("updated_at")),
        })
        .select(*stored.columns)
    )


def ingest_transactions(
    transactions: DataFrame, stored: DataFrame, batch: DataFrame, now: dt.datetime, categories: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append valid rows that bring their own ids, and add their signed sums to the account balances.

    An id that is stored already, or that the batch holds twice, is refused.
    """
    checked = _repeated(checked_transactions(batch, stored, categories))
    used = transactions.select("id", F.lit(True).alias("_used"))
    checked = checked.join(used, "id", "left").withColumn("reason", F.coalesce(
        F.when(F.col("_used"), "id already used").when(F.col("_times") > 1, "id given more than once"), "reason"))
    accepted = checked.filter("reason IS NULL").select(*transactions.columns)
    return transactions.unionByName(accepted), _with_changes(stored, accepted, now), _report(checked, F.col("reason"))


def create_transactions(
    transactions: DataFrame, stored: DataFrame, categories: DataFrame, batch: DataFrame, now: dt.datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create rows with new ids: (the new rows, accounts, report with ``request_id`` and the new ``id``).

    ``batch`` has a unique ``request_id`` and no ids. Accepted rows get the ids
    above the largest stored one in the order of their requests; append the new
    rows with ``versions.commit`` or ``sinks.append_transactions``.
    """
    checked = written(checked_transactions(batch, stored, categories), "checked")
    accepted = with_new_ids(checked.filter("reason IS NULL"), ["request_id"], largest_id(transactions))
    report = checked.select("request_id", "reason").join(accepted.select("request_id", "id"), "request_id", "left").select(
        "request_id", "id", F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"), "reason")
    new = accepted.select(*[c for c in transactions.columns if c in accepted.columns])
    return new, _with_changes(stored, new, now), report


def delete_transactions(
    transactions: DataFrame, stored: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete by (id, user_id) and recompute the balances of the accounts concerned."""
    asked = requests.select("id", "user_id").distinct()
    hit = transactions.join(asked, ["id", "user_id"], "left_semi").select("id", "user_id", "account_id")
    left = transactions.join(asked, ["id", "user_id"], "left_anti").select(*transactions.columns)
    touched = hit.filter("account_id IS NOT NULL").select("account_id").distinct().withColumn("_touched", F.lit(True))
    totals = with_account_totals(stored, left)
    recomputed = (F.col("initial_balance") + F.col("total_income") - F.col("total_expense")).cast(TOTAL)
    accounts = (
        totals.join(touched, totals["id"] == touched["account_id"], "left")
        .withColumn("balance", F.when(F.col("_touched"), recomputed).otherwise(F.col("balance")))
        .select(*stored.columns)
    )
    report = _asked_and_found(asked, hit)
    return left, accounts, _report(report, F.when(F.col("_found").isNull(), "not found"))


# --- budgets -----------------------------------------------------------------

def close_budgets(budgets: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set budgets inactive; unknown and already closed ones are reported."""
    asked = requests.select("id").distinct()
    state = asked.join(budgets.select("id", "is_active"), "id", "left")
    report = _report(
        state, F.when(F.col("is_active").isNull(), "not found").when(~F.col("is_active"), "already closed")
    )
    flagged = asked.withColumn("_close", F.lit(True))
    changed = budgets.join(flagged, "id", "left").withColumn(
        "is_active", F.col("is_active") & F.col("_close").isNull()
    )
    return changed.select(*budgets.columns), report


def delete_budgets_cascade(
    budgets: DataFrame, limits: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete own budgets (id, user_id) together with their limits."""
    asked = requests.select("id", "user_id").distinct()
    own = budgets.join(asked, ["id", "user_id"], "left_semi").select("id", "user_id")
    gone, report = own.select("id"), _asked_and_found(asked, own)
    kept = budgets.join(asked, ["id", "user_id"], "left_anti").select(*budgets.columns)
    return (
        kept,
        anti_on_key(limits, gone, "budget_id", "id"),
        _report(report, F.when(F.col("_found").isNull(), "not found")),
    )


def upsert_budgets(
    budgets: DataFrame, limits: DataFrame, edits: DataFrame, limit_edits: DataFrame, categories: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create or edit budgets and their category limits.

    ``edits``: id, user_id, name, period_type, start_date, end_date,
    total_expense_limit. ``limit_edits``: id, budget_id, category_id,
    limit_amount, is_deleted. An edit is refused when its end is not after its
    start or when it names another user's budget; limit edits of refused
    budgets are dropped with them, others are judged by ``upsert_limits``.
    """
    owners = budgets.select("id", F.col("user_id").alias("_owner"))
    looked = _repeated(edits).join(shuffled(owners), "id", "left")
    reason = F.when(F.col("_times") > 1, "edited more than once").when(
        F.col("_owner").isNotNull() & ~F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False)), "not found"
    ).when(~F.coalesce(F.col("end_date") > F.col("start_date"), F.lit(False)), "end date must be after start date")
    looked = looked.withColumn("reason", reason)
    good = looked.filter("reason IS NULL").select(*edits.columns)

    editable = ["name", "period_type", "start_date", "end_date", "total_expense_limit"]
    change = good.select("id", F.lit(True).alias("_hit"), F.col("user_id").alias("_user"),
                         *[F.col(c).alias("_" + c) for c in editable])
    merged = budgets.join(shuffled(change), "id", "full_outer").select(
        "id",
        *[F.when(F.col("_hit"), F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in editable],
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
        F.coalesce("user_id", "_user").alias("user_id"),
    ).select(*budgets.columns)

    new_limits, _ = upsert_limits(limits, merged, categories, _dropped_with(limit_edits, looked))
    return merged, new_limits, _report(looked, F.col("reason"))


def _dropped_with(limit_edits: DataFrame, looked: DataFrame) -> DataFrame:
    """Limit edits without those of refused budgets."""
    refused = looked.filter("reason IS NOT NULL").select("id").distinct()
    return anti_on_key(limit_edits, shuffled(refused), "budget_id", "id")


def upsert_limits(
    limits: DataFrame, budgets: DataFrame, categories: DataFrame | None, edits: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Create, change or delete category limits: (limits, report).

    ``edits``: id, budget_id, category_id, limit_amount, is_deleted and, if
    given, user_id of the editor. Refused are edits given twice, of budgets
    that do not exist or are not the editor's, of limits of other budgets,
    and, unless they delete, those without an amount, on a category that is
    not an OUTCOME one the budget's owner sees, and on a budget's category
    that already has a limit or is asked for by an edit with a smaller id.
    """
    owners = budgets.select(F.col("id").alias("budget_id"), F.col("user_id").alias("_owner")).withColumn("_known", F.lit(True))
    before = limits.select("id", F.col("budget_id").alias("_budget"))
    # What needs the budget and the category is settled first; then everything by id, edits being dealt by it once.
    looked = edits.withColumn("_edit", F.monotonically_increasing_id()).join(shuffled(owners), "budget_id", "left")
    editor = F.col("user_id") if "user_id" in edits.columns else F.col("_owner")
    fits = F.lit(True)
    if categories is not None:
        looked = category_lookup(looked, categories, spread="id")
        seen = F.col("category_is_system") | (F.col("category_owner_id") == F.col("_owner"))
        fits = F.coalesce((F.col("category_type") == OUTCOME) & seen, F.lit(False))
    looked = looked.select(
        "id", "budget_id", "category_id", "limit_amount", F.coalesce("is_deleted", F.lit(False)).alias("_gone"), "_edit",
        (F.col("_known").isNull() | ~editor.eqNullSafe(F.col("_owner"))).alias("_foreign"), fits.alias("_fits"))
    same_id = Window.partitionBy("id")
    again = F.col("id").isNotNull() & (F.min("_edit").over(same_id) < F.max("_edit").over(same_id))
    looked = looked.withColumn("_again", again).join(shuffled(before), "id", "left").withColumn(
        "reason",
        F.when(F.col("_again"), "edited more than once")
        .when(F.col("_foreign"), "budget not found")
        .when(F.col("_budget").isNotNull() & (F.col("_budget") != F.col("budget_id")), "limit of another budget")
        .when(F.col("_gone") & F.col("_budget").isNull(), "not found")
        .when(~F.col("_gone") & F.col("limit_amount").isNull(), "amount required")
        .when(~F.col("_gone") & ~F.col("_fits"), "category not allowed"))

    good = looked.filter("reason IS NULL").select("id", F.col("budget_id").alias("_b"), F.col("category_id").alias("_c"),
                                                  F.col("limit_amount").alias("_a"), "_gone", F.lit(True).alias("_hit"))
    merged = limits.join(shuffled(good), "id", "full_outer").filter(~F.coalesce("_gone", F.lit(False)))
    placed = _placed(merged)
    kept = placed.filter(F.col("_out") & (F.col("_ob").isNotNull() | ~F.col("_moved") | ~F.coalesce("_twin", F.lit(False))))
    there = ~F.col("_moved") | ~F.col("_twin")
    kept = kept.select(
        "id",
        F.when(there, F.coalesce(F.when(~F.col("_moved"), F.col("_ob")), "_pb")).otherwise(F.col("_ob")).alias("budget_id"),
        F.when(there, F.col("_pc")).otherwise(F.col("_oc")).alias("category_id"),
        F.when(there, F.col("_a")).otherwise(F.col("_oa")).alias("limit_amount"))
    twins = placed.filter("_twin").select("id", F.lit("category already has a limit").alias("_twin"))
    report = looked.join(shuffled(twins), "id", "left")
    return kept.select(*limits.columns), _report(report, F.coalesce("reason", "_twin"))


def _placed(merged: DataFrame) -> DataFrame:
    """Places (_pb, _pc) that limits hold and edits take, with ``_twin`` where an edit finds its place taken.

    ``merged`` are limits with the edit (_b, _c, _a, _hit) of each. A limit that
    an edit moves gives two rows: the place it holds, which is no result row
    (``_out``), and the one it asks for. An edit that takes a place meets whoever
    holds it now, then the edits with smaller ids. All of that is one shuffle
    by place; places with a NULL equal nothing and are scattered.
    """
    hit = F.coalesce("_hit", F.lit(False))
    holds = F.col("budget_id").isNotNull()
    moved = hit & ~(holds & F.col("category_id").eqNullSafe(F.col("_c")))
    amount = F.when(moved, F.lit(None)).when(hit, F.col("_a")).otherwise(F.col("limit_amount"))
    elsewhere = F.when(hit & ~moved & (F.col("_b") != F.col("budget_id")), F.col("_b"))  # an id of several budgets
    nothing = F.lit(None).cast("long")
    stays = F.struct(F.col("budget_id").alias("_pb"), F.col("category_id").alias("_pc"), F.lit(False).alias("_moved"), (~moved).alias("_out"),
                     amount.cast(MONEY).alias("_a"), elsewhere.alias("_ob"), nothing.alias("_oc"), nothing.cast(MONEY).alias("_oa"))
    goes = F.struct(F.col("_b").alias("_pb"), F.col("_c").alias("_pc"), F.lit(True).alias("_moved"), F.lit(True).alias("_out"),
                    F.col("_a").cast(MONEY).alias("_a"), F.col("budget_id").alias("_ob"), F.col("category_id").alias("_oc"),
                    F.col("limit_amount").alias("_oa"))
    both = F.when(moved & holds, F.array(stays, goes)).when(moved, F.array(goes)).otherwise(F.array(stays))
    whole = F.when(F.col("_pb").isNotNull(), F.col("_pc"))
    rows = merged.select("id", F.inline(both)).withColumn("_slot", null_slot(whole, "id"))
    first = F.min(F.struct("_moved", "id")).over(Window.partitionBy("_pb", "_pc", "_slot"))["id"]
    return rows.withColumn("_twin", F.col("_moved") & F.when(F.col("_slot") == 0, first != F.col("id")))


# --- accounts ----------------------------------------------------------------

def open_accounts(stored: DataFrame, batch: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Add accounts whose balance starts at the initial balance; (name, user) stays unique."""
    names = stored.select("name", "user_id").distinct().withColumn("_taken", F.lit(True))
    twins = batch.groupBy("name", "user_id").agg(F.min("id").alias("_first"))
    looked = batch.join(twins, ["name", "user_id"], "left").join(names, ["name", "user_id"], "left")
    keyed = F.col("user_id").isNotNull() & F.col("name").isNotNull()
    reason = F.when(
        F.col("_taken") | (keyed & (F.col("_first") != F.col("id"))), "name already used"
    )
    looked = looked.withColumn("reason", reason)
    added = looked.filter("reason IS NULL").withColumns({
        "balance": F.col("initial_balance").cast(TOTAL),
        "is_active": F.lit(True),
        "updated_at": F.lit(now),
    })
    return stored.unionByName(added.select(*stored.columns)), _report(looked, F.col("reason"))


def upsert_accounts(stored: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change name and account type of own accounts; empty values leave a column as it is."""
    def given(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c))

    change = _repeated(edits).select(
        "id", F.col("user_id").alias("_user"), given("name").alias("_name"), given("account_type").alias("_type"), "_times"
    )
    looked = change.join(stored.select("id", "user_id"), "id", "left")
    own = F.coalesce(F.col("user_id") == F.col("_user"), F.lit(False))
    once = F.col("_times") == 1
    report = _report(looked, F.when(~own, "not found").when(~once, "edited more than once"))
    mine = looked.filter(own & once).select("id", "_name", "_type")
    changed = stored.join(mine, "id", "left").withColumns({
        "name": F.coalesce("_name", "name"), "account_type": F.coalesce("_type", "account_type"),
    })
    return changed.select(*stored.columns), report


def delete_accounts_guarded(
    stored: DataFrame, transactions: DataFrame, recurring: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete own accounts that have no rows; others are kept and their row count reported.

    Recurring templates of a deleted account go with it.
    """
    asked = requests.select("id", "user_id").distinct()
    counted = with_account_totals(stored.join(asked, ["id", "user_id"], "left_semi"), transactions)
    state = asked.join(counted.select("id", "user_id", "transaction_count"), ["id", "user_id"], "left")
    reason = F.when(F.col("transaction_count").isNull(), "not found").when(
        F.col("transaction_count") > 0,
        F.concat(F.lit("has "), F.col("transaction_count").cast("string"), F.lit(" transactions")),
    )
    gone = counted.filter("transaction_count = 0").select("id")
    kept = stored.join(gone, "id", "left_anti").select(*stored.columns)
    return kept, anti_on_key(recurring, gone, "account_id", "id"), _report(state, reason)


# --- categories, users, currencies, templates ----------------------------------

def _null_key(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """NULL a foreign key that points at a deleted row."""
    flagged = gone.toDF("_gone").withColumn("_hit", F.lit(True))
    joined = left_lookup(df, flagged, key, "id", "_gone")
    return joined.withColumn(key, F.when(F.col("_hit").isNull(), F.col(key))).select(*df.columns)


def delete_categories_cascade(L: Ledger, requests: DataFrame, recompute: bool = False) -> tuple[Ledger, DataFrame]:
    """Delete own categories (id, user_id): their rows and limits go, templates lose the key.

    Balances stay as they are unless ``recompute``; the reconciliation shows the drift.
    """
    asked = requests.select("id", "user_id").distinct()
    own = L["categories"].join(asked, ["id", "user_id"], "left_semi").select("id", "user_id")
    gone, report = own.select("id"), _asked_and_found(asked, own)
    out: dict[str, DataFrame] = {}
    out["categories"] = L["categories"].join(gone, "id", "left_anti").select(*L["categories"].columns)
    out["transactions"] = anti_on_key(L["transactions"], gone, "category_id", "id")
    out["limits"] = anti_on_key(L["limits"], gone, "category_id", "id")
    out["recurring"] = _null_key(L["recurring"], gone, "category_id")
    if recompute:
        totals = with_account_totals(L["accounts"], out["transactions"])
        balance = (F.col("initial_balance") + F.col("total_income") - F.col("total_expense")).cast(TOTAL)
        out["accounts"] = totals.withColumn("balance", balance).select(*L["accounts"].columns)
    return L.replaced(**out), _report(report, F.when(F.col("_found").isNull(), "not found"))


def delete_users_cascade(L: Ledger, requests: DataFrame) -> tuple[Ledger, DataFrame]:
    """Delete users and everything they own, rows of others on their accounts and categories included."""
    asked = requests.select("id").distinct()
    found = L["users"].join(asked, "id", "left_semi").select("id")
    report = asked.join(found.withColumn("_found", F.lit(True)), "id", "left")

    def owned_by_gone(table: str) -> DataFrame:
        return L[table].join(found.toDF("user_id"), "user_id", "left_semi").select("id")

    out: dict[str, DataFrame] = {}
    out["users"] = L["users"].join(found, "id", "left_anti").select(*L["users"].columns)
    for table in ("categories", "accounts", "transactions", "recurring", "budgets"):
        out[table] = anti_on_key(L[table], found, "user_id", "id").select(*L[table].columns)
    categories, accounts, budgets = (owned_by_gone(t) for t in ("categories", "accounts", "budgets"))
    out["transactions"] = anti_on_key(anti_on_key(out["transactions"], accounts, "account_id", "id"),
                                      categories, "category_id", "id")
    out["recurring"] = _null_key(anti_on_key(out["recurring"], accounts, "account_id", "id"), categories, "category_id")
    out["limits"] = anti_on_key(anti_on_key(L["limits"], budgets, "budget_id", "id"), categories, "category_id", "id")
    return L.replaced(**out), _report(report, F.when(F.col("_found").isNull(), "not found"))


def delete_recurring(recurring: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = requests.select("id", "user_id").distinct()
    report = _asked_and_found(asked, recurring.join(asked, ["id", "user_id"], "left_semi"))
    kept = recurring.join(asked, ["id", "user_id"], "left_anti").select(*recurring.columns)
    return kept, _report(report, F.when(F.col("_found").isNull(), "not found"))


def currency_delete_set_null(
    users: DataFrame, currencies: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = requests.select("id").distinct()
    gone = currencies.join(asked, "id", "left_semi").select("id")
    report = asked.join(gone.withColumn("_found", F.lit(True)), "id", "left")
    kept = currencies.join(asked, "id", "left_anti").select(*currencies.columns)
    return _null_key(users, gone, "currency_id"), kept, _report(
        report, F.when(F.col("_found").isNull(), "not found")
    )
