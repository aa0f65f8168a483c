"""Structured Streaming forms of the ledger's event-driven behaviour.

Every micro-batch writes its own ``batch_id=N`` folder in overwrite mode, so a
batch replayed after a failure replaces its earlier attempt and is counted
once. Readers combine the folders with aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyframe.functions import scalars as X
from tallyframe.operators.mutations import checked_transactions
from tallyframe.schema import TOTAL
from tallyframe.streaming.batches import batch_path, merge, parts


def file_stream(
    spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


# --- rows and balances -----------------------------------------------------------

_CHANGE = f"account_id bigint, change {TOTAL}"


def _summed_changes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account_id").agg(F.sum("change").cast(TOTAL).alias("change"))


def stream_ingest(source: DataFrame, accounts: DataFrame, out: str, merge_every: int = 20) -> StreamingQuery:
    """Check arriving rows, store the valid ones and the balance changes they cause.

    Every ``merge_every`` batches the earlier balance changes are merged into one copy.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = checked_transactions(batch, accounts)
        checked.write.mode("overwrite").parquet(batch_path(out, "checked", batch_id))
        stored = spark.read.schema(checked.schema).parquet(batch_path(out, "checked", batch_id))
        merge(spark, out, "changes", _CHANGE, batch_id, merge_every, _summed_changes)
        kept = stored.filter("reason IS NULL AND account_id IS NOT NULL")
        _summed_changes(kept.select("account_id", X.signed_amount().alias("change"))).write.mode(
            "overwrite").parquet(batch_path(out, "changes", batch_id))

    return _start(source, write, f"{out}/checkpoint", "append")


def streamed_balances(spark: SparkSession, accounts: DataFrame, out: str) -> DataFrame:
    """Balances after all batches written so far."""
    changes = _summed_changes(parts(spark, out, "changes", _CHANGE))
    joined = accounts.join(changes, accounts["id"] == changes["account_id"], "left")
    return joined.select(
        F.col("id").alias("account_id"),
        (F.col("initial_balance") + F.coalesce("change", F.lit(0))).cast(TOTAL).alias("balance"),
    )


# --- daily statistics --------------------------------------------------------------

_DAILY = f"day date, user_id bigint, type string, total {TOTAL}, row_count bigint"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "user_id", "type").agg(
        F.sum("total").cast(TOTAL).alias("total"), F.sum("row_count").alias("row_count"))


def _daily_sums(rows: DataFrame, sign: Column) -> DataFrame:
    days = rows.filter(F.col("user_id").isNotNull()).select(
        F.col("ts").cast("date").alias("day"), "user_id", "type",
        (F.col("amount") * sign).alias("total"), sign.cast("long").alias("row_count"))
    return _summed(days)


def _start_daily(source: DataFrame, out: str, merge_every: int, sums: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        merge(batch.sparkSession, out, "daily", _DAILY, batch_id, merge_every, _summed)
        sums(batch).write.mode("overwrite").parquet(batch_path(out, "daily", batch_id))

    return _start(source, write, f"{out}/checkpoint", "append")


def stream_daily_stats(source: DataFrame, out: str, merge_every: int = 20) -> StreamingQuery:
    """Sums per day, user and type of arriving rows; ``ts`` is the event time.

    Each batch stores its own partial sums, which add up, so a row counts
    however late it comes and nothing is kept as state. Every ``merge_every``
    batches the earlier sums are merged into one copy.
    """
    return _start_daily(source, out, merge_every, lambda batch: _daily_sums(batch, F.lit(1)))


def signed_images(changes: DataFrame) -> DataFrame:
    """The rows a change adds (``sign`` 1) and takes back (``sign`` -1).

    ``changes`` holds the structs ``old`` and ``new`` (user_id, type, amount,
    ts): an insert has no old, a delete no new and an edit both. A change
    without either says nothing.
    """
    images = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("old").alias("image")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("image")))
    return changes.select(F.explode(images).alias("c")).filter("c.image IS NOT NULL").select("c.sign", "c.image.*")


def stream_daily_changes(source: DataFrame, out: str, merge_every: int = 20) -> StreamingQuery:
    """``stream_daily_stats`` of a change stream: edits and deletes take earlier rows back.

    Sums are signed and add up, so changes may come in any order, a delete
    before its insert included, and an edit may move a row to another day,
    user or type.
    """
    return _start_daily(source, out, merge_every, lambda batch: _daily_sums(signed_images(batch), F.col("sign")))


def streamed_daily_stats(spark: SparkSession, out: str) -> DataFrame:
    """The sums of every day, user and type that has rows after all batches written so far."""
    return _summed(parts(spark, out, "daily", _DAILY)).filter("row_count <> 0")


# --- change history ------------------------------------------------------------------

_LAST = "account_id bigint, image string, batch_no bigint"


def _last_images(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("account_id").agg(F.max_by(F.struct("image", "batch_no"), "batch_no").alias("r"))
    return newest.select("account_id", "r.image", "r.batch_no")


def dealt_changes(changes: DataFrame, path: str) -> DataFrame:
    """The changes stored in ranges of (account, ``seq``), with the range's number as ``_part``.

    Spark samples the bounds, so ranges are about equal however many changes one
    account has and however sparse ``seq`` is: a busy account spans many ranges.
    """
    rows = changes.repartitionByRange("account_id", "seq").withColumn("_part", F.spark_partition_id())
    rows.write.mode("overwrite").parquet(path)
    return changes.sparkSession.read.schema(rows.schema).parquet(path)


def with_old_images(dealt: DataFrame, known: DataFrame | None) -> DataFrame:
    """``dealt`` changes with ``old_data``: the account's image before each.

    Inside a range it is the row before. The first row of an account in a range
    takes the account's last image in an earlier range, carried over one row per
    account and range, or else the image ``known`` from before.
    """
    inside = Window.partitionBy("_part", "account_id").orderBy("seq")
    rows = dealt.withColumn("_earlier", F.lag(F.struct("image")).over(inside))
    carried = _range_ends(dealt).withColumn(
        "_carried", F.lag("_end").over(Window.partitionBy("account_id").orderBy("_part")))
    if known is not None:
        before = known.select("account_id", F.struct("image").alias("_known"))
        carried = carried.join(before, "account_id", "left").withColumn("_carried", F.coalesce("_carried", "_known"))
    carried = carried.select(F.col("_part").alias("_in"), F.col("account_id").alias("_of"), "_carried")
    same = (rows["_part"] == carried["_in"]) & rows["account_id"].eqNullSafe(carried["_of"])
    old = F.coalesce("_earlier", "_carried")["image"]
    return rows.join(carried, same, "left").withColumn("old_data", old).drop("_earlier", "_carried", "_in", "_of")


def _range_ends(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("account_id", "_part").agg(F.max_by(F.struct("image"), "seq").alias("_end"))


def stream_account_history(source: DataFrame, out: str, compact_every: int = 20) -> StreamingQuery:
    """Audit log of a change stream (seq, account_id, user_id, image; NULL image deletes).

    Unlike a snapshot pair this keeps every intermediate update. Each batch
    leaves the last image of the accounts it changed; every ``compact_every``
    batches these are merged into a full copy, so a batch reads one copy and
    at most ``compact_every`` batches, not the whole log. A batch's changes are
    dealt into even ranges first, so no task holds all changes of an account.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merge(spark, out, "last", _LAST, batch_id, compact_every, _last_images)
        known = _last_images(parts(spark, out, "last", _LAST, batch_id)) if batch_id > 0 else None
        dealt = dealt_changes(batch.select("seq", "account_id", "user_id", "image"), f"{out}/dealt")
        action = (
            F.when(F.col("old_data").isNull() & F.col("image").isNotNull(), "INSERT")
            .when(F.col("image").isNull() & F.col("old_data").isNotNull(), "DELETE")
            .when(F.col("image").isNotNull(), "UPDATE")
        )
        log = with_old_images(dealt, known).withColumn("action", action).filter("action IS NOT NULL")
        log.select(
            "account_id", "seq", "action", F.col("user_id").alias("changed_by"), "old_data",
            F.col("image").alias("new_data"),
        ).write.mode("overwrite").parquet(batch_path(out, "log", batch_id))

        last = _range_ends(dealt).groupBy("account_id").agg(F.max_by("_end", "_part").alias("r"))
        last.select("account_id", "r.image", F.lit(batch_id).cast("long").alias("batch_no")).write.mode(
            "overwrite"
        ).parquet(batch_path(out, "last", batch_id))

    return _start(source, write, f"{out}/checkpoint", "append")


def streamed_history(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/log").drop("batch_id")
