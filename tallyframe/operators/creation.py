"""New categories and recurring templates from requests, with ids of their own.

``batch`` frames carry a unique ``request_id`` and no ids. Each operator
returns the new rows and a report (request_id, id, status, reason); append the
rows with ``versions.commit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import account_ownership_check
from tallyframe.plans.ids import largest_id, with_new_ids
from tallyframe.plans.keys import category_lookup
from tallyframe.schema import ENUMS, NAME_LENGTHS
from tallyframe.session import written


def _created(checked: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows of ``table`` from the requests without a ``reason``, and the report on all."""
    checked = written(checked, "requests")
    accepted = with_new_ids(checked.filter("reason IS NULL"), ["request_id"], largest_id(table))
    report = checked.select("request_id", "reason").join(accepted.select("request_id", "id"), "request_id", "left").select(
        "request_id", "id", F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"), "reason")
    return accepted.select(*table.columns), report


def _one_of(c: str, enum: str) -> Column:
    return F.coalesce(F.col(c).isin(ENUMS[enum]), F.lit(False))


def create_categories(categories: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own categories (request_id, user_id, name, type); a name is unique among its user's, the first request has it.

    Categories made here are never system ones, whatever the batch says.
    """
    used = categories.filter("NOT is_system").select("name", "user_id").distinct().withColumn("_used", F.lit(True))
    name = F.trim("name")
    valid = (F.length(name) > 0) & (F.length(name) <= NAME_LENGTHS["category"]) & _one_of("type", "type") & F.col("user_id").isNotNull()
    rows = batch.withColumn("name", name).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    first = rows.filter("_valid").groupBy("name", "user_id").agg(F.min("request_id").alias("_first"))
    rows = rows.join(first, ["name", "user_id"], "left").join(used, ["name", "user_id"], "left")
    reason = (
        F.when(F.col("user_id").isNull(), "user required")
        .when(F.coalesce(F.length("name"), F.lit(0)) == 0, "name required")
        .when(F.length("name") > NAME_LENGTHS["category"], "name too long")
        .when(~_one_of("type", "type"), "invalid type")
        .when(F.col("_used") | (F.col("_first") != F.col("request_id")), "name already used")
    )
    own = rows.withColumns({"reason": reason, "is_system": F.lit(False)})
    return _created(own.select("request_id", "name", "type", "is_system", "user_id", "reason"), categories)


def create_recurring(
    recurring: DataFrame, accounts: DataFrame, categories: DataFrame, batch: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Recurring templates on an own, active account and, if any, a visible category of the same type."""
    rows = category_lookup(
        account_ownership_check(batch, accounts.filter("is_active"), "request_id"), categories, "request_id")
    seen = F.col("category_is_system") | (F.col("category_owner_id") == F.col("user_id"))
    fits = F.coalesce(seen & (F.col("category_type") == F.col("type")), F.lit(False))
    reason = (
        F.when(~_one_of("type", "type"), "invalid type")
        .when(~_one_of("frequency", "frequency"), "invalid frequency")
        .when(F.col("amount").isNull(), "amount required")
        .when(F.col("start_date").isNull(), "start date required")
        .when(F.col("account_id").isNull() | ~F.col("account_ok"), "account not found or access denied")
        .when(F.col("category_id").isNotNull() & ~fits, "category not allowed")
    )
    return _created(rows.withColumn("reason", reason).select(*batch.columns, "reason"), recurring)
