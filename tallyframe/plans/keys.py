"""Join and ranking shapes that stay even when one key holds much of the data.

No operator hints a broadcast: Catalyst and AQE broadcast a side when its
size allows and shuffle it otherwise. What is done here is to keep the
shuffled form even:

* NULL keys of a left or anti join are scattered instead of meeting in one task;
* system categories, which every user's rows share, are looked up on a salted key;
* positions inside a group are counted in blocks of bounded size;
* exploded and grouped sides that grow with the ledger are kept from being broadcast,
  and their partitions from being merged.

Other joins keep the large table on the side AQE's skew handling may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCATTER = 4096
SALTS = 64
BLOCK_BITS = 16


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is not broadcast, for sides that grow with the ledger.

    The optimizer takes exploded rows to be as few as what they come from and
    grouped ones to be narrow, and would have the driver hold them whole.
    """
    return df.hint("merge")


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all of the session's shuffle partitions.

    AQE merges partitions by their compressed bytes; rows of ids and dates
    compress so well that a merged partition fills a task's memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def null_slot(key: str | Column, spread: str | Column) -> Column:
    """0 for a row with a key, else one of many slots above 0.

    Joins add the slot to the key and put the other side at slot 0: a NULL key
    stays NULL and equals nothing, whatever ids there are, and its rows do not
    meet in one task.
    """
    key = F.col(key) if isinstance(key, str) else key
    spread = F.col(spread) if isinstance(spread, str) else spread
    return F.when(key.isNotNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SCATTER)).cast("int"))


def slot_zero(key: str) -> Column:
    """The other side's slot, 0 for every row.

    Computed from the key: the optimizer would fold a literal into a condition
    beside the join, and the slots would no longer spread the NULL keys.
    """
    return F.pmod(F.xxhash64(key), F.lit(1)).cast("int")


def left_lookup(fact: DataFrame, dim: DataFrame, key: str, spread: str, dim_key: str = "id") -> DataFrame:
    """Left join on a nullable foreign key; ``dim_key`` is unique and dropped."""
    k, slot = "_lookup_key", "_lookup_slot"
    renamed = dim.withColumnRenamed(dim_key, k).withColumn(slot, slot_zero(k))
    return (
        fact.withColumns({k: F.col(key).cast("long"), slot: null_slot(key, spread)})
        .join(renamed, [k, slot], "left")
        .drop(k, slot)
    )


def anti_on_key(fact: DataFrame, keys: DataFrame, key: str, spread: str) -> DataFrame:
    """Rows whose nullable ``key`` is not among the one-column frame ``keys``."""
    k, slot = "_anti_key", "_anti_slot"
    wanted = keys.toDF(k).withColumn(slot, slot_zero(k))
    return fact.withColumns({k: F.col(key).cast("long"), slot: null_slot(key, spread)}).join(
        wanted, [k, slot], "left_anti").drop(k, slot)


def salted_join(
    fact: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "left"
) -> DataFrame:
    """Join to a short table whose few keys are each shared by very many rows.

    ``small`` is copied to ``SALTS`` slots and rows pick a slot by the hash of
    ``spread``, so a shuffled plan splits each hot key over all slots. With
    ``on=[]`` every row meets every row of ``small``.
    """
    slot = "_slot"
    copies = small.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        fact.withColumn(slot, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
        .join(copies, [*on, slot], how)
        .drop(slot)
    )


def category_lookup(
    fact: DataFrame, categories: DataFrame, spread: str, key: str = "category_id", prefix: str = "category_"
) -> DataFrame:
    """Add name, type, is_system and owner of ``key``'s category under ``prefix``.

    System categories are shared by all users, so they are matched by a salted
    join. The remaining rows look up own categories, where a key belongs to one
    user; resolved rows are scattered so that they do not meet again on a hot id.
    """
    fields = ["name", "type", "is_system", "user_id"]
    out = [prefix + ("owner_id" if f == "user_id" else f) for f in fields]

    def side(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(F.col("id").alias(tag), slot_zero("id").alias(tag + "_null"), F.struct(*fields).alias(tag + "_row"))

    first = salted_join(
        fact.withColumns({"_sys": F.col(key).cast("long"), "_sys_null": null_slot(key, spread)}),
        side(categories.filter("is_system"), "_sys"), ["_sys", "_sys_null"], [spread],
    )
    unresolved = F.when(F.col("_sys_row").isNull(), F.col(key)).cast("long")
    second = first.withColumns({"_own": unresolved, "_own_null": null_slot(unresolved, spread)}).join(
        side(categories.filter("NOT is_system"), "_own"), ["_own", "_own_null"], "left"
    )
    return second.withColumn("_row", F.coalesce("_sys_row", "_own_row")).select(
        *fact.columns, *[F.col("_row")[f].alias(o) for f, o in zip(fields, out)]
    )


def position_in_group(df: DataFrame, group: list[str], id_col: str, name: str) -> DataFrame:
    """Dense 0-based position of each row in its group, ordered by unique ``id_col``.

    ids are cut into blocks of 2^16; rows are ranked inside (group, block),
    which holds at most 65,536 rows, and block sizes are summed per group.
    """
    block = F.shiftright(F.col(id_col), BLOCK_BITS)
    tagged = df.withColumn("_block", block)
    sizes = tagged.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, "_block").orderBy(id_col)
    return (
        tagged.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, [*group, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_block", "_rank", "_offset")
    )
