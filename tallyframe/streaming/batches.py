"""Tables a stream writes batch by batch, with merged copies now and then.

Every micro-batch owns the folder ``batch_id=N`` of a table. A merged copy in
``<table>_base/batch_id=N`` stands for all batches before N, so a reader takes
the newest copy and the batches from N on, however often copies are made. A
copy counts once its own batch is stored: one that was being written when a run
broke off is not read, and the replayed batch overwrites it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_path(out: str, table: str, batch_id: int) -> str:
    return f"{out}/{table}/batch_id={batch_id}"


def base_of(table: str) -> str:
    return f"{table}_base"


def _found(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest_copy(spark: SparkSession, out: str, table: str, schema: str, before: int | None = None) -> int:
    """Number of the newest whole merged copy, of those made before a batch if given; 0 for none."""
    copies = _found(spark, f"{out}/{base_of(table)}", schema)
    names = copies.inputFiles() if copies is not None else []
    numbers = {int(n) for name in names for n in re.findall(r"/batch_id=(\d+)/", name)}
    for n in sorted(numbers, reverse=True):
        if (before is None or n < before) and _found(spark, batch_path(out, table, n), schema) is not None:
            return n
    return 0


def parts(spark: SparkSession, out: str, table: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of the newest merged copy and of the batches after it, up to a batch if given."""
    first = newest_copy(spark, out, table, schema, before)
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{out}/{table}").filter(F.col("batch_id") >= first)
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    rows = rows.drop("batch_id")
    if first:
        rows = rows.unionByName(spark.read.schema(schema).parquet(batch_path(out, base_of(table), first)))
    return rows


def merge(
    spark: SparkSession, out: str, table: str, schema: str, batch_id: int, every: int, merged: Callable[[DataFrame], DataFrame]
) -> None:
    """Before every ``every``-th batch: write ``merged`` of all earlier rows as the batch's copy."""
    if batch_id > 0 and batch_id % every == 0:
        merged(parts(spark, out, table, schema, batch_id)).write.mode("overwrite").parquet(
            batch_path(out, base_of(table), batch_id))
