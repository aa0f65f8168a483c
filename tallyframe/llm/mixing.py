"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources that hold
them). A pattern offers its words up to ``max_repeats`` times, each further
copy at a higher cost; flow runs from patterns through their sources to the
sources' quotas, at the least cost of repetition. Sources tied together by
patterns form one network; the networks are solved in parallel, one task's
group each, and hold one node per pattern and source, never documents.

A pattern's flow becomes whole copies of all its documents and a remainder,
which is filled in the order of a seeded hash. Where the remainder ends is
found by two histograms of the hash, so no task sorts a whole source. The last
document may be taken in part, which makes the sum exact.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import connected_components, stored

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"


class FlowNetwork:
    """Maximum flow of least cost by shortest augmenting paths."""

    def __init__(self):
        self.arcs: list[list[int]] = []  # to, capacity left, cost
        self.out: dict[object, list[int]] = defaultdict(list)

    def arc(self, a: object, b: object, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, start: object, end: object) -> None:
        while True:
            cost, came, queue = {start: 0}, {}, deque([start])
            while queue:
                a = queue.popleft()
                for k in self.out[a]:
                    b, left, c = self.arcs[k]
                    if left > 0 and cost[a] + c < cost.get(b, 1 << 60):
                        cost[b], came[b] = cost[a] + c, k
                        queue.append(b)
            if end not in came:
                return
            path, at = [], end
            while at != start:
                path.append(came[at])
                at = self.arcs[came[at] ^ 1][0]
            push = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= push
                self.arcs[k ^ 1][1] += push


def routed(patterns: dict[str, tuple[int, list[int]]], quotas: dict[int, int], max_repeats: int = MAX_REPEATS) -> dict[str, int]:
    """Words each pattern gives: {pattern: (words, sources)} and {source: quota} to {pattern: words taken}."""
    net = FlowNetwork()
    copies = {
        p: [net.arc("from", ("p", p), words, k) for k in range(max_repeats)] for p, (words, _) in sorted(patterns.items())
    }
    for p, (words, sources) in sorted(patterns.items()):
        for s in sources:
            net.arc(("p", p), ("s", s), words * max_repeats, 0)
    for s, quota in sorted(quotas.items()):
        net.arc(("s", s), "to", quota, 0)
    net.run("from", "to")
    return {p: sum(net.arcs[k + 1][1] for k in arcs) for p, arcs in copies.items()}


def targets(sizes: DataFrame, total: int, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(number, source, source_size, target) from (source, source_size).

    Sources in code point order, NULL last, have the weights in turn and share
    ``total``; a target stops at ``max_repeats`` times the source's size and
    the excess is shared again until none is above. Sums of the source table
    decide each round; the table itself stays distributed.
    """
    last = F.col("source").isNull()
    parts = stored(
        sizes.repartitionByRange(last, F.col("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    place = Window.partitionBy("part").orderBy(last, "source")
    ahead = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    numbered = parts.withColumn("k", F.row_number().over(place) - 1).join(ahead, "part").select(
        (F.col("k") + F.col("before")).alias("number"), "source", "source_size")
    numbered = stored(numbered.withColumn("weight", cycle[(F.col("number") % len(weights)).cast("int")]), "mix-sources")
    limit = F.col("source_size") * max_repeats
    # The share of a weight is rest / weights; it only grows, so what is capped stays capped.
    rest, share = total, numbered.agg(F.sum("weight")).first()[0] or 1
    while True:
        over = F.lit(rest) * F.col("weight") > limit * F.lit(share)
        capped, left = numbered.agg(
            F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        again = (total - (capped or 0), left or 1)
        if again == (rest, share):
            break
        rest, share = again
    over = F.lit(rest) * F.col("weight") > limit * F.lit(share)
    even = (F.lit(rest) * F.col("weight")).cast("double") / F.lit(share)
    return numbered.select("number", "source", "source_size", F.when(over, limit.cast("double")).otherwise(even).alias("target"))


def pattern_of(sources: Column) -> Column:
    return F.to_json(F.sort_array(F.array_distinct(sources)), {"ignoreNullFields": "false"})


def mix(
    docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS, seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): (id, size, pattern, taken) of every row, and (source, source_size, target) of every source.

    ``sources`` is the array of a document's sources; NULL as an element is a
    source of its own. size is the number of words, 0 for NULL. taken is the
    words the mix takes of a document, at most max_repeats times its size.
    Rows that repeat an id are documents of their own with one place in the
    seeded order, told apart by size; NULL ids have one place too. An empty
    table gives empty results.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = stored(docs.select(
        F.col(id_col).cast("long").alias("id"), sources.alias("members"), size.alias("size"), key.alias("key")
    ).withColumn("pattern", pattern_of("members")), "mix-sizes")
    patterns = stored(sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words")), "mix-patterns")
    held = patterns.select("pattern", "words", F.explode(F.array_distinct("members")).alias("source"))
    total = patterns.agg(F.sum("words")).first()[0] or 0
    aims = stored(targets(held.groupBy("source").agg(F.sum("words").alias("source_size")), total, weights, max_repeats), "mix-targets")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    links = held.join(aims.select(F.col("source").alias("s"), "number", quota.alias("quota")), F.col("source").eqNullSafe(F.col("s")))
    nets = stored(links.groupBy("pattern").agg(
        F.first("words").alias("words"), F.min("number").alias("head"), F.collect_list(F.struct("number", "quota")).alias("ends")), "mix-links")
    ties = nets.filter(F.size("ends") > 1).select(F.col("head").alias("a"), F.explode("ends.number").alias("b"))
    joined = connected_components(ties).withColumnRenamed("node", "head")
    nets = nets.join(joined, "head", "left").withColumn("net", F.coalesce("root", "head"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        quotas = {int(e["number"]): int(e["quota"]) for ends in group["ends"] for e in ends}
        given = {p: (int(w), [int(e["number"]) for e in ends]) for p, w, ends in zip(group["pattern"], group["words"], group["ends"], strict=True)}
        got = routed(given, quotas, max_repeats)
        return pd.DataFrame({"pattern": list(got), "flow": [got[p] for p in got], "words": [given[p][0] for p in got]})

    flows = nets.groupBy("net").applyInPandas(solve, "pattern string, flow long, words long")
    some = F.col("words") > 0
    flows = stored(flows.select(
        "pattern", F.when(some, F.floor(F.col("flow") / F.col("words"))).otherwise(0).cast("long").alias("copies"),
        F.when(some, F.col("flow") % F.col("words")).otherwise(0).cast("long").alias("rest")), "mix-flows")
    cut1 = _cut(sized, flows.withColumnRenamed("rest", "rest1"), 1)
    cut2 = stored(_cut(sized, cut1, 2), "mix-cuts")

    at = sized.join(cut2, "pattern", "left")
    b1, b2 = F.substring("key", 1, 3), F.substring("key", 4, 3)
    inside = (b1 == F.col("cut1")) & (b2 == F.col("cut2"))
    before = (b1 < F.col("cut1")) | ((b1 == F.col("cut1")) & (b2 < F.col("cut2")))
    base = F.coalesce("copies", F.lit(0)) * F.col("size")
    rough = at.filter(~F.coalesce(inside, F.lit(False))).select(
        "id", "size", "pattern", (base + F.when(before, F.col("size")).otherwise(0)).alias("taken"))
    order = Window.partitionBy("pattern").orderBy("key", F.col("id").isNull(), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    fine = at.filter(inside).withColumn("sum", F.coalesce(F.sum("size").over(order), F.lit(0))).select(
        "id", "size", "pattern",
        (base + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest3") - F.col("sum")))).alias("taken"))
    return rough.unionByName(fine).withColumnRenamed("id", id_col), aims.select("source", "source_size", "target")


def _cut(sized: DataFrame, cuts: DataFrame, level: int) -> DataFrame:
    """``cuts`` with the bucket of the seeded hash in which each pattern's remainder ends, and what is left for it."""
    bucket = F.substring("key", 3 * level - 2, 3)
    rows = sized.select("pattern", "key", "size")
    if level == 2:
        rows = rows.join(cuts.select("pattern", "cut1"), "pattern").filter(F.substring("key", 1, 3) == F.col("cut1"))
    sums = rows.groupBy("pattern", bucket.alias("b")).agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("b"))
    rest = F.col(f"rest{level}")
    hit = sums.withColumn("upto", upto).join(cuts.select("pattern", rest.alias("r")), "pattern").filter(
        "upto >= r AND upto - n < r").select("pattern", F.col("b").alias(f"cut{level}"), (F.col("r") - F.col("upto") + F.col("n")).alias(f"rest{level + 1}"))
    return cuts.join(hit, "pattern", "left")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): every document under the source in its ``source`` column."""
    taken, sources = mix(docs, F.array("source"))
    named = sources.select(pattern_of(F.array("source")).alias("pattern"), "source_size", "target")
    return taken.join(named, "pattern").select("doc_id", "size", "source_size", "target", "taken")
