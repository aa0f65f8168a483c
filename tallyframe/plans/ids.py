"""Ids for new rows, dense and above those in use, without gathering the rows.

Rows are range-partitioned and sorted by their order and written once with
their partition and place in it. One count per partition gives each
partition's offset; a row's id is the largest stored id plus its partition's
offset plus its place. No task sees more than its own partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import written
from tallyframe.sources.literals import literal_rows

#: Bits of monotonically_increasing_id that count the rows of a partition.
PLACE_BITS = 33


def largest_id(table: DataFrame, id_col: str = "id") -> int:
    """The largest id in use, 0 for an empty table; one value reaches the driver."""
    return table.agg(F.max(id_col)).first()[0] or 0


def with_new_ids(rows: DataFrame, order: list[str | Column], above: int = 0, id_col: str = "id") -> DataFrame:
    """``rows`` with ``id_col``: above + 1, above + 2, ... in ``order``, which must tell all rows apart.

    The result is stored, so that ids stay the same however often it is read.
    An existing column of that name is replaced; no rows give no ids.
    """
    base = rows.drop(id_col)
    place = F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)
    dealt = base.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(dealt.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = list(accumulate((n for _, n in counts), initial=above))
    kind = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_offset", T.LongType())])
    offsets = literal_rows(rows.sparkSession, [(p, e) for (p, _), e in zip(counts, ends)] or [(0, above)], kind)
    return numbered.join(offsets, "_part").select(
        (F.col("_offset") + F.col("_place") + 1).alias(id_col), *base.columns)
