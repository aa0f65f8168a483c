"""Tables, stored intermediate results and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Large-star and small-star steps alternate until the edges are stars. Each
    step is a minimum per node (combined before the shuffle) joined back to
    the edges, so a node with very many edges is split by AQE like any skewed
    join. Every round is stored; only its checksum reaches the driver. NULL
    ends and loops are no edges.
    """
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    current = stored(pairs, "components")
    before = None
    for _ in range(max_rounds):
        sums = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if sums[0] == 0 or tuple(sums) == before:
            break
        before = tuple(sums)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").filter("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
