"""Synthetic transactions for many users.

All draws of a row come from one hash of (seed, user, row number), so a rerun
or another partitioning yields the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.keys import position_in_group, salted_join
from tallyframe.schema import INCOME, INCOME_DESCRIPTIONS, MONEY, OUTCOME, OUTCOME_DESCRIPTIONS

DAYS_BACK = 60
OUTCOME_SHARE = 70
DRAW_BITS = 20


def _draw(slot: int, n: Column | int) -> Column:
    """Integer in [0, n) from 20 bits of the row's hash."""
    hex_part = F.substring("_hash", slot * 5 + 1, 5)
    value = F.conv(hex_part, 16, 10).cast("long")
    return F.shiftright(value * (F.lit(n) if isinstance(n, int) else n), DRAW_BITS)


def _pick(texts: list[str], slot: int) -> Column:
    choices = F.array(*[F.lit(t) for t in texts])
    return F.element_at(choices, (_draw(slot, len(texts)) + 1).cast("int"))


def generate_transactions(
    users: DataFrame, accounts: DataFrame, categories: DataFrame, n_per_user: int, as_of: dt.date, seed: int = 7
) -> DataFrame:
    """``n_per_user`` rows per user with an active account, over the 61 days up to ``as_of``.

    Accounts and own categories are numbered inside their user, and a drawn
    number is an equi-join key, so no list of a user's rows is ever collected.
    A row whose type has no visible category is skipped. The drawn numbers always
    exist, and left joins keep the multiplied rows on the side that is never
    broadcast.
    """
    active = position_in_group(
        accounts.filter("is_active").select(F.col("id").alias("account_id"), "user_id"),
        ["user_id"], "account_id", "_acc_no",
    )
    n_active = accounts.filter("is_active").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n_acc"))
    own = position_in_group(
        categories.filter("NOT is_system AND user_id IS NOT NULL").select(
            F.col("id").alias("_own_id"), "user_id", "type"
        ),
        ["user_id", "type"], "_own_id", "_own_no",
    )
    n_own = categories.filter("NOT is_system AND user_id IS NOT NULL").groupBy("user_id", "type").agg(
        F.count(F.lit(1)).alias("_n_own")
    )
    system = categories.filter("is_system").select(F.col("id").alias("_sys_id"), "type")
    system = position_in_group(system, ["type"], "_sys_id", "_sys_no")

    def n_system(kind: str) -> Column:
        return categories.filter("is_system").agg(F.count_if(F.col("type") == kind).alias("n")).scalar()

    numbers = F.explode(F.sequence(F.lit(1), F.lit(n_per_user))).alias("_no")
    # Each user becomes n_per_user rows, so the few bytes per user are spread before that.
    parts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    people = users.select(F.col("id").alias("user_id")).join(n_active, "user_id").repartition(parts, F.xxhash64("user_id"))
    rows = people.select("user_id", "_n_acc", numbers)
    rows = rows.withColumn("_hash", F.md5(F.concat_ws("/", F.lit(str(seed)), "user_id", "_no")))
    rows = rows.withColumn("type", F.when(_draw(0, 100) < OUTCOME_SHARE, OUTCOME).otherwise(INCOME))
    is_income = F.col("type") == INCOME

    rows = rows.withColumn("_acc_no", _draw(1, F.col("_n_acc")))
    rows = rows.join(active.select("user_id", "_acc_no", "account_id"), ["user_id", "_acc_no"], "left")
    rows = rows.join(n_own, ["user_id", "type"], "left").withColumn(
        "_n_sys", F.when(is_income, n_system(INCOME)).otherwise(n_system(OUTCOME))
    )
    n_sys, n_mine = F.col("_n_sys"), F.coalesce("_n_own", F.lit(0))
    rows = rows.withColumn("_cat_no", _draw(2, n_sys + n_mine)).withColumns({
        "_sys_no": F.when(F.col("_cat_no") < n_sys, F.col("_cat_no")),
        "_own_no": F.when(F.col("_cat_no") >= n_sys, F.col("_cat_no") - n_sys),
    })
    rows = rows.join(own.select("user_id", "type", "_own_no", "_own_id"), ["user_id", "type", "_own_no"], "left")
    rows = salted_join(rows, system, ["type", "_sys_no"], ["user_id", "_no"])

    cents = F.when(is_income, _draw(4, 490_001) + 10_000).otherwise(_draw(4, 49_001) + 1_000)
    return rows.withColumn("category_id", F.coalesce("_sys_id", "_own_id")).filter("category_id IS NOT NULL").select(
        "user_id",
        F.col("_no").alias("row_no"),
        "type",
        (cents.cast("decimal(16,0)") / 100).cast(MONEY).alias("amount"),
        F.date_add(F.lit(as_of - dt.timedelta(days=DAYS_BACK)), _draw(3, DAYS_BACK + 1).cast("int")).alias("date"),
        F.when(is_income, _pick(INCOME_DESCRIPTIONS, 5)).otherwise(_pick(OUTCOME_DESCRIPTIONS, 5)).alias("description"),
        "category_id",
        "account_id",
    )
