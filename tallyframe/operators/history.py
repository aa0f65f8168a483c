"""Change history as the difference of two snapshots.

A trigger also sees updates that change nothing and every intermediate
update; a snapshot pair cannot. The stream form keeps intermediate updates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X


def change_history(
    old: DataFrame, new: DataFrame, entity: str, now: dt.datetime, actor: int | None = None
) -> DataFrame:
    """INSERT, UPDATE and DELETE rows with both row images as JSON.

    The actor falls back to the new, then the old owner. Rows of deleted
    entities stay in the log.
    """
    columns = new.columns
    before = old.select(F.col("id"), F.col("user_id").alias("_old_user"), X.row_json(*columns).alias("old_data"))
    after = new.select(F.col("id"), F.col("user_id").alias("_new_user"), X.row_json(*columns).alias("new_data"))
    action = (
        F.when(F.col("old_data").isNull(), "INSERT")
        .when(F.col("new_data").isNull(), "DELETE")
        .when(F.col("old_data") != F.col("new_data"), "UPDATE")
    )
    return (
        before.join(after, "id", "full_outer")
        .withColumn("action", action)
        .filter("action IS NOT NULL")
        .select(
            F.col("id").alias(entity),
            "action",
            F.coalesce(F.lit(actor).cast("long"), "_new_user", "_old_user").alias("changed_by"),
            F.lit(now).alias("changed_at"),
            "old_data",
            "new_data",
        )
    )


def account_history(old: DataFrame, new: DataFrame, now: dt.datetime, actor: int | None = None) -> DataFrame:
    return change_history(old, new, "account_id", now, actor)


def budget_history(old: DataFrame, new: DataFrame, now: dt.datetime, actor: int | None = None) -> DataFrame:
    return change_history(old, new, "budget_id", now, actor)


def history_by_entity(log: DataFrame, entity: str, entity_id: int | None = None) -> DataFrame:
    """Log in time order, of one entity if given."""
    if entity_id is not None:
        log = log.filter(F.col(entity) == F.lit(entity_id))
    return log.orderBy(entity, "changed_at", "action")
