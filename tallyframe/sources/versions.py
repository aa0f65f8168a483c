"""Versioned commits of ledger tables: a change shows whole or not at all.

A store is a folder with data folders, one per written table and commit, and
one manifest per version that lists the folders of every table. The manifest
is a single file written last, so a reader sees the newest whole version, and
a writer that dies leaves folders nobody lists. Unchanged tables keep their
folders; rows can be appended to a table as one more folder, so that a commit
costs its new rows. Facts stay in month folders, which date filters skip.

A commit may carry a run id: a run that is repeated finds its id in the
history and changes nothing. Two writers from the same version meet at the
manifest's folder, which only the first can create.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import schema as S
from tallyframe.functions import scalars as X
from tallyframe.sources.ledger import LEDGER_SCHEMAS, Ledger
from tallyframe.sources.literals import literal_rows

MANIFEST = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("folder", T.StringType()),
])
SCHEMAS = LEDGER_SCHEMAS | {"recurring_log": S.RECURRING_LOG, "recurring_days": S.RECURRING_DAY}
#: Tables in month folders.
BY_MONTH = {"transactions", "recurring_log"}


class Conflict(RuntimeError):
    """Another writer has made the version this commit was to make."""


def history(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all versions: (version, run_id, table_name, folder), NULL table for none."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def newest(spark: SparkSession, root: str) -> int:
    """The newest whole version, 0 for an empty store."""
    return history(spark, root).agg(F.max("version")).first()[0] or 0


def _folders(spark: SparkSession, root: str, version: int) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in history(spark, root).filter(F.col("version") == version).orderBy("folder").collect():
        if r["table_name"]:
            out.setdefault(r["table_name"], []).append(r["folder"])
    return out


def read(spark: SparkSession, root: str, version: int | None = None) -> Ledger:
    """The tables of a version, the newest by default. Facts carry their ``month`` for folder skipping."""
    found = _folders(spark, root, newest(spark, root) if version is None else version)

    def of(name: str) -> DataFrame:
        schema = SCHEMAS[name]
        if name in BY_MONTH:
            schema = T.StructType([*schema.fields, T.StructField("month", T.DateType())])
        if name not in found:
            return spark.createDataFrame([], schema)
        files = spark.read.schema(schema).option("basePath", f"{root}/data/{name}")
        return files.parquet(*[f"{root}/{f}" for f in found[name]]).select(*schema.names)

    return Ledger({name: (lambda n=name: of(n)) for name in SCHEMAS})


def _write(name: str, df: DataFrame, path: str) -> None:
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
    if name in BY_MONTH:
        # AQE splits a heavy month over several writers and merges light ones.
        typed.withColumn("month", X.month_of("date")).hint("rebalance", "month").write.partitionBy("month").parquet(path)
    else:
        typed.write.parquet(path)


def commit(
    spark: SparkSession,
    root: str,
    replace: Mapping[str, DataFrame] | None = None,
    append: Mapping[str, DataFrame] | None = None,
    run_id: str | None = None,
    base: int | None = None,
) -> int:
    """Store changed tables and appended rows as one new version and return its number.

    ``base`` is the version the change was computed from, the newest by
    default; ``Conflict`` is raised if it is no longer the newest. With a
    ``run_id`` that an earlier version carries nothing is written and that version is returned.
    """
    log = history(spark, root)
    if run_id is not None:
        done = log.filter(F.col("run_id") == run_id).agg(F.min("version")).first()[0]
        if done is not None:
            return done
    now = newest(spark, root)
    if base is not None and base != now:
        raise Conflict(f"version {base} is no longer the newest, {now} is")
    folders = _folders(spark, root, now)
    mark = uuid.uuid4().hex
    for name, df in (replace or {}).items():
        folders[name] = [f"data/{name}/commit={now + 1:08d}-{mark}"]
        _write(name, df, f"{root}/{folders[name][0]}")
    for name, df in (append or {}).items():
        added = f"data/{name}/commit={now + 1:08d}-{mark}-more"
        _write(name, df, f"{root}/{added}")
        folders.setdefault(name, []).append(added)
    rows = [(now + 1, run_id, n, f) for n, some in folders.items() for f in some] or [(now + 1, run_id, None, None)]
    try:
        literal_rows(spark, rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{root}/manifests/{now + 1:08d}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"version {now + 1} was made by another writer") from e
    return now + 1
