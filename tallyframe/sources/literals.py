"""Fixed values as SQL literals and as inline tables, which Catalyst sizes exactly and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal_rows(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f.name for f in schema)
    typed = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})")
