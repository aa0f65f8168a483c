"""Centroid clustering with equal-average equal-variance nearest centroid search.

Centroids are sorted by the sum of their components. A vector starts at the
centroid whose sum is next to its own and scans outward on both sides. With k
components, sums S and deviations D (the length of what is left once the mean
is taken out), the squared distance is at least (Sx - Sc)^2 / k, and at least
(Sx - Sc)^2 / k + (Dx - Dc)^2. The first bound ends the scan of
a vector; the second passes over single centroids; what is left is measured
exactly in integers, so that pruning never changes a result.

Vectors stay in their partitions: each round ships the centroids (count times
components, parameters) to the tasks and brings back one row of sums per
cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored

CENTROIDS, DIMENSIONS, ROUNDS, SCALE = 40, 64, 5, 256
#: Larger components could make a distance pass 64 bits; they are refused.
LARGEST = 1 << 27
#: Vectors searched together.
AT_ONCE = 8192


class SortedCentroids:
    """Centroids in the order of their component sums, with the numbers they are known by."""

    def __init__(self, centroids: np.ndarray):
        total = centroids.sum(axis=1)
        self.number = np.lexsort((np.arange(len(centroids)), total))
        self.rows = centroids[self.number]
        self.total = total[self.number]
        self.deviation = deviations(self.rows)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest centroid (ties: the smaller number), the squared distance, and how many distances were computed."""
        n, k = x.shape
        count = len(self.rows)
        total, deviation = x.sum(axis=1), deviations(x)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
        up = np.searchsorted(self.total, total)  # the next centroid to look at on either side
        down = up - 1
        open_, computed = np.arange(n), 0
        while len(open_):
            u, d = up[open_], down[open_]
            gap_u = np.where(u < count, np.abs(self.total[np.minimum(u, count - 1)] - total[open_]), np.iinfo(np.int64).max)
            gap_d = np.where(d >= 0, np.abs(self.total[np.maximum(d, 0)] - total[open_]), np.iinfo(np.int64).max)
            rise = gap_u <= gap_d
            gap, at = np.where(rise, gap_u, gap_d), np.where(rise, u, d)
            # The nearer side's mean bound ends the scan: all centroids still unseen are at least as far in the mean.
            live = (at >= 0) & (at < count) & (gap <= _root(best[open_], k))
            open_, at, gap, rise = open_[live], at[live], gap[live], rise[live]
            up[open_[rise]] += 1
            down[open_[~rise]] -= 1
            apart = deviation[open_] - self.deviation[at]
            bound = gap.astype(float) ** 2 / k + apart * apart
            near = bound * (1 - 1e-9) - 1 <= best[open_]
            rows, cand = open_[near], at[near]
            diff = x[rows] - self.rows[cand]
            dist = np.einsum("ij,ij->i", diff, diff)
            computed += len(rows)
            number = self.number[cand]
            better = (dist < best[rows]) | ((dist == best[rows]) & (number < who[rows]))
            best[rows[better]], who[rows[better]] = dist[better], number[better]
        return who, best, computed


def deviations(rows: np.ndarray) -> np.ndarray:
    """Length of each row without its mean."""
    wide = rows.astype(float)
    return np.sqrt(((wide - wide.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) if rows.shape[1] else np.zeros(len(rows))


def _root(best: np.ndarray, k: int) -> np.ndarray:
    """A number not below sqrt(k * best); gaps beyond it cannot hold a nearer or equally near centroid."""
    return np.sqrt(best.astype(float) * k) * (1 + 1e-9) + 1


def _matrices(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(a, AT_ONCE)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, k)
            if x.size and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST} could make a distance pass 64 bits")
            yield part.column(0), x


def _sums(rows: DataFrame, centroids: np.ndarray) -> list:
    """Row count and component sums of every cluster: one row per cluster and task, added up by Spark."""
    k = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = SortedCentroids(centroids)
        total, n = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, x in _matrices(batches, k):
            who, _, _ = search.nearest(x)
            order = np.argsort(who, kind="stable")
            held, start = np.unique(who[order], return_index=True)
            total[held] += np.add.reduceat(x[order], start, axis=0).astype(object)
            n += np.bincount(who, minlength=len(n))
        held = np.flatnonzero(n)
        place = np.tile(np.arange(k, dtype=np.int32), len(held))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, k).astype(np.int32)), pa.array(place), pa.array([str(v) for v in total[held].ravel()], pa.string()),
             pa.array(np.repeat(n[held], k))], ["cluster", "place", "total", "n"])

    parts = rows.mapInArrow(add, "cluster int, place int, total string, n long")
    return parts.groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.sum("n").alias("n")).collect()


def whole_vectors(vec_col: str, dimensions: int) -> Column:
    """Whether a row is kept: exactly ``dimensions`` components, none NULL or non-finite."""
    x = F.col(vec_col).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(x) == dimensions) & ~odd, F.lit(False))


def cluster(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, dimensions: int = DIMENSIONS,
    scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, the final centroids).

    Components become floor(scale * x). The first centroids are the vectors
    with the smallest sha256 of ``seed:id`` (equal ids: the smaller vector
    first; a NULL id hashes as empty). Empty clusters keep their centroid;
    ties go to the smaller number. Rows that repeat an id count each; rows
    without exactly ``dimensions`` finite components are left out; fewer
    vectors than centroids make fewer centroids, none give an empty result. A
    component beyond 2^27 after scaling raises, as distances are 64-bit. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(whole_vectors(vec_col, dimensions)).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.floor(c * scale).cast("long")).alias("v"))
    rows = stored(kept, "integer-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.withColumn("h", name).orderBy("h", "v").limit(centroids).select("v").collect()
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema), np.zeros((0, dimensions), np.int64)
    now = np.array([r["v"] for r in first], np.int64).reshape(len(first), dimensions)
    for _ in range(rounds):
        moved = now.copy()
        for r in _sums(rows, now):
            moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        now = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = SortedCentroids(now)
        for ids, x in _matrices(batches, dimensions):
            who, distance, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(who.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    given = stored(rows.mapInArrow(assign, "id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    number = F.col("cluster") + 1
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    out = given.select(
        F.col("id").alias(id_col), "cluster", "distance",
        F.element_at(F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(now))]), number).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.lit(s) for s in shas]), number).alias("centroid_sha256"))
    return out, now
