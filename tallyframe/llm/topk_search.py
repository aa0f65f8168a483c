"""Exact top-k inner-product search by distributed histogram selection.

Queries are answered in blocks of bounded size against every candidate row.
Each round scores everything and adds up, per query, a histogram of the scores
still in question; the bin with the k-th value becomes the next round's range
until it is one score wide. The last round keeps what lies above that score,
and of the ties only the smallest ids. Nothing is pruned or approximated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import shared_dir

#: Queries whose vectors travel to all tasks at once.
BLOCK = 1024
#: Bins of a round's histogram.
BINS = 1024
EXACT_FLOAT = 2.0**53


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows of one length) of each batch."""
    for batch in batches:
        ids, vec = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        size = np.diff(vec.offsets.to_numpy())
        flat = vec.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(size)))
        for width in np.unique(size):
            rows = np.flatnonzero(size == width)
            yield ids[rows], flat[at[rows][:, None] + np.arange(width)] if width else np.zeros((len(rows), 0), np.int64)


class QueryBlock:
    """The vectors of a block of queries and each one's range of scores still in question."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.ids = np.array(ids, np.int64)
        widths = np.array([len(v) for v in vectors])
        self.by_width = {
            int(w): (at := np.flatnonzero(widths == w), np.array([vectors[i] for i in at], np.int64).reshape(len(at), int(w)))
            for w in np.unique(widths)
        }

    def scores(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query places, ids of some rows, their scores, mark of pairs to leave out); equal lengths only."""
        found = self.by_width.get(rows.shape[1])
        if found is None or not len(rows):
            return
        at, q = found
        step = max(1, (1 << 22) // max(1, len(at)))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            if rows.shape[1] and float(np.abs(q.astype(float)).max()) * float(np.abs(part.astype(float)).max()) * rows.shape[1] < EXACT_FLOAT:
                s = (q.astype(float) @ part.T.astype(float)).astype(np.int64)
            else:
                s = q @ part.T
            yield at, ids[a : a + step], s, self.ids[at][:, None] == ids[None, a : a + step]


def _bins(batches: Iterator[pa.RecordBatch], block: QueryBlock, low: np.ndarray, high: np.ndarray, width: np.ndarray, need: np.ndarray) -> Iterator[pd.DataFrame]:
    """This task's histogram of each query's range, from the top down to its own k-th value; nothing below can hold the global one."""
    total = np.zeros((len(low), BINS), np.int64)
    for ids, rows in _matrices(batches):
        for at, some, s, own in block.scores(ids, rows):
            b = (s - low[at][:, None]) // width[at][:, None]
            ok = (s >= low[at][:, None]) & (s <= high[at][:, None]) & ~own
            total += np.bincount((at[:, None] * BINS + b)[ok], minlength=total.size).reshape(total.shape)
    above = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total
    q, b = np.nonzero((total > 0) & (above < need[:, None]))
    yield pd.DataFrame({"q": q.astype(np.int32), "bin": b.astype(np.int32), "n": total[q, b]})


def _winners(batches: Iterator[pa.RecordBatch], block: QueryBlock, edge: np.ndarray, ties: np.ndarray) -> Iterator[pd.DataFrame]:
    """Scores above each query's edge, and this task's smallest ids at the edge."""
    held: dict[int, list[int]] = {}
    for ids, rows in _matrices(batches):
        for at, some, s, own in block.scores(ids, rows):
            k, c = np.nonzero((s > edge[at][:, None]) & ~own)
            if len(k):
                yield pd.DataFrame({"q": at[k].astype(np.int32), "vec_id": some[c], "score": s[k, c]})
            k, c = np.nonzero((s == edge[at][:, None]) & ~own)
            for q in np.unique(at[k]).tolist():
                mine = some[c[at[k] == q]].tolist()
                held[q] = sorted(held.get(q, []) + mine)[: int(ties[q])]
    out = [(q, i) for q, some in held.items() for i in some]
    if out:
        q = np.array([x for x, _ in out], np.int32)
        yield pd.DataFrame({"q": q, "vec_id": np.array([i for _, i in out], np.int64), "score": edge[q]})


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    Components become floor(scale * x). Candidates are all rows but those with
    the query's own id; fewer than k are all returned; ties go to the smaller
    id. NULL ids, NULL vectors and vectors with NULL or non-finite components
    take no part; vectors of other lengths are no candidates of a query; rows
    that repeat an id are candidates each, and query rows that repeat an id are
    answered once. Other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_q"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    base = base.filter(F.col("id").isNotNull() & x.isNotNull()).filter(~odd)
    base = base.select("id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"), "is_q")
    rows = base.select("id", "v")
    asked = base.filter("is_q").select("id", "v")
    facts = base.agg(
        F.max(F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c))), F.lit(0))).alias("largest"), F.max(F.size("v")).alias("width"),
        F.sum(F.when(F.col("is_q"), 1).otherwise(0)).alias("asked"),
    ).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["asked"]:
        return spark.createDataFrame([], schema)
    blocks = math.ceil(facts["asked"] / BLOCK)
    out = shared_dir(spark, "topk")
    for number in range(blocks):
        one = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).groupBy("id").agg(F.min("v").alias("v")).collect()
        if not one:
            continue
        block = QueryBlock([r["id"] for r in one], [r["v"] for r in one])
        edge, ties = _edges(rows, block, [r["v"] for r in one], facts["largest"] or 0, k)
        found = rows.mapInArrow(
            lambda it, b=block, e=edge, t=ties: (pa.RecordBatch.from_pandas(p, preserve_index=False) for p in _winners(it, b, e, t)),
            "q int, vec_id long, score long",
        )
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(block.ids)], "q int, query_id long")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked.join(names, "q").select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _edges(rows: DataFrame, block: QueryBlock, vectors: list[list[int]], largest: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k-th highest score, and how many rows with just that score belong to its result."""
    n = len(block.ids)
    reach = [largest * sum(abs(c) for c in v) + 1 for v in vectors]
    reach = np.array([min(r, 2**61) for r in reach], np.int64)
    low, high, need = -reach, reach.copy(), np.full(n, k, np.int64)
    edge, ties = np.full(n, -(2**62), np.int64), np.full(n, k, np.int64)
    open_ = np.ones(n, bool)
    while open_.any():
        width = np.maximum(1, -((low - high - 1) // BINS))
        counted = rows.mapInArrow(
            lambda it, w=width, lo=low.copy(), hi=high.copy(), nd=np.where(open_, need, 0): (pa.RecordBatch.from_pandas(p, preserve_index=False) for p in _bins(it, block, lo, hi, w, nd)),
            "q int, bin int, n long",
        )
        above = Window.partitionBy("q").orderBy(F.desc("bin"))
        total = counted.groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(above))
        wanted = rows.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(need) if open_[i]], "q int, need long")
        hit = total.join(wanted, "q").filter("upto >= need AND upto - n < need").select("q", "bin", "n", "upto").collect()
        reached = {r["q"]: r for r in hit}
        for q in np.flatnonzero(open_).tolist():
            r = reached.get(q)
            if r is None:  # fewer than k candidates: all belong to the result
                open_[q] = False
                continue
            need[q] -= r["upto"] - r["n"]
            low[q] += r["bin"] * width[q]
            high[q] = low[q] + width[q] - 1
            if width[q] == 1:
                edge[q], ties[q], open_[q] = low[q], need[q], False
    return edge, ties
