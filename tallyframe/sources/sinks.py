"""Writers and export row shapes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as X
from tallyframe.sources.ledger import LEDGER_SCHEMAS


def append_transactions(df: DataFrame, path: str) -> None:
    """Append to the fact table, partitioned by month.

    The rebalance hint lets AQE split a heavy month over several writers and
    merge light ones, so neither one task nor thousands of small files result.
    """
    (
        df.withColumn("month", X.month_of("date"))
        .hint("rebalance", "month")
        .write.mode("append")
        .partitionBy("month")
        .parquet(path)
    )


def write_snapshot(ledger: Mapping[str, DataFrame], path: str) -> None:
    """Store changed tables in a new folder.

    The tables read from the old version while they are written, so an existing
    folder is refused. Reading the snapshot back also cuts the lineage of a
    chain of changes, on storage that outlives executors.
    """
    for name, df in ledger.items():
        schema = LEDGER_SCHEMAS[name]
        typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        typed.write.mode("error").parquet(f"{path}/{name}")


def export_transactions_json(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.to_json(
            F.struct(
                "id",
                "type",
                F.col("amount").cast("string").alias("amount"),
                F.col("date").cast("string").alias("date"),
                "description",
                F.col("category_id").alias("category"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("json"),
    )


def export_categories_json(categories: DataFrame) -> DataFrame:
    return categories.select("id", X.row_json("id", "name", "type", "is_system").alias("json")).orderBy("id")


def write_json(exported: DataFrame, path: str) -> None:
    exported.select("json").write.mode("overwrite").text(path)
