"""Exact Jaccard join on word shingles with count vectors and an R-tree.

A document's shingles are hashed into groups and its counts per group are a
point. Two sets share at most the sum of the smaller counts of each group, so
a pair can be linked only if that sum reaches the overlap the threshold needs;
an R-tree over the points bounds whole boxes of documents the same way, by
their largest counts.

Random texts of one length lie on one shell of that space, where boxes of an
R-tree over all points overlap and exclude nothing, so the upper part of the
index is made of fine groups, one per shingle hash: of a set of ``n`` only
``n - need + 1`` groups can be left out of an overlap of ``need``, so two linked
points share one of their first ``n - need + 1`` occupied fine groups in any
common order. Each such group is a region of the index with an R-tree of its
own. The order puts groups that very many documents occupy last (they come
from counts over all documents), which keeps regions small; it changes no
result. What passes the bound is bounded once more by finer count vectors and
then verified on the whole texts.

Sets that are equal are one node. Nodes are first tied to the leader of their
min-hash groups and verified, so that a large group of near copies is one
component before regions are searched; only pairs of different components are
looked at, and never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textkit as K
from tallyframe.llm.common import connected_components, stored

WORDS, PERCENT = 5, 80
#: Groups of the count vectors.
GROUPS = 256
#: Groups of the finer count vectors that candidates are bounded by before their texts meet; a multiple of ``GROUPS``.
FINE = 1024
LEADERS, ROUNDS = 4, 3
#: A shingle is common if more documents hold it than this and than 2^-20 of all shingles; so at most 2^20 are common.
COMMON, COMMON_SHARE = 64, 1 << 20
#: Shingles a task gathers before it hands on counts or regions.
GATHERED = 1 << 20
#: Places of a task's table of sets it has entered.
SEEN = 1 << 18
#: Shingle hashes in one task's share of the regions.
SHARE = 1 << 20
#: Nodes of a region handled together; larger regions are cut and their parts paired.
REGION = 1024
LEAF, FANOUT = 16, 8
#: Ids of candidates that are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
_LEADER_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shared shingles that sets of ``a`` and ``b`` need: 100 * shared >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes in rising order, each text's first)."""
    for a, b, data, off in K.text_chunks(column):
        folded = K.FOLD[data]
        starts, ends, first = K.word_spans(folded, off, K.SPACED)
        yield a, b, *K.distinct_sorted(*K.shingle_hashes(K.span_hashes(folded, starts, ends), first, words))


def set_codes(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for key in _LEADER_KEYS[:2]:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(sets ^ key))))
        out.append(K.mix(total[first[1:]] - total[first[:-1]] + key).view(np.int64))
    return out[0], out[1]


def packed(counts: np.ndarray) -> bytes:
    """A count vector in one byte a group, or four where a count needs more."""
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.empty((len(rows), GROUPS), np.uint32)
    wide = np.array([len(r) > GROUPS for r in rows], bool)
    for mask, kind in ((~wide, np.uint8), (wide, np.uint32)):
        at = np.flatnonzero(mask)
        out[at] = np.frombuffer(b"".join(rows[k] for k in at), kind).reshape(len(at), GROUPS)
    return out


_SIGNED = "doc_id long, n long, lo long, hi long, mins array<long>, counts binary, shingle long, held long"


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("mins", pa.list_(pa.int64())),
                          ("counts", pa.binary()), ("shingle", pa.int64()), ("held", pa.int64())])
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            shingle, n = np.unique(np.concatenate(held), return_counts=True)
            many = n > 1
            k = int(many.sum())
            none = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.binary()),
                                               pa.array(shingle[many].view(np.int64)), pa.array(n[many])], schema=kind)

        for batch in batches:
            for a, b, sets, first in shingle_sets(batch.column(1), words):
                lo, hi = set_codes(sets, first)
                n = np.diff(first)
                full = np.flatnonzero(n > 0)
                mins = np.zeros((b - a, LEADERS), np.int64)
                counts = np.zeros((b - a, GROUPS), np.uint32)
                if len(full):
                    for k, key in enumerate(_LEADER_KEYS[:LEADERS]):
                        mins[full, k] = np.minimum.reduceat(K.mix(sets * key), first[:-1][full]).view(np.int64)
                    cell = np.repeat(np.arange(b - a), n) * GROUPS + (sets % np.uint64(GROUPS)).astype(np.int64)
                    counts = np.bincount(cell, minlength=(b - a) * GROUPS).astype(np.uint32).reshape(b - a, GROUPS)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(n), pa.array(lo), pa.array(hi), pa.array(mins.tolist(), pa.list_(pa.int64())),
                    pa.array([packed(c) for c in counts], pa.binary()), none, none], schema=kind)
                held.append(sets)
                size += len(sets)
                if size >= GATHERED:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return run


def _regions(words: int, percent: int, common: np.ndarray, blocks: int):
    """Rows of (block, region keys, set codes): the fine groups under which each set is entered."""
    shift = np.uint64(64 - (blocks - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        seen = np.zeros(SEEN, np.int64)

        def dealt() -> Iterator[pa.RecordBatch]:
            keys, codes, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            # Common groups need no meeting here, so they are spread by document instead.
            block = (np.where(hot, K.mix(codes.view(np.uint64)), keys) >> shift).astype(np.int64) if blocks > 1 else np.zeros(len(keys), np.int64)
            block = block * 2 + hot
            order = np.argsort(block, kind="stable")
            block, keys, codes = block[order], keys[order], codes[order]
            at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            ends = np.append(at[1:], len(block))
            for a in range(0, len(at), 512):
                part = list(zip(at[a : a + 512].tolist(), ends[a : a + 512].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(block[at[a : a + 512]]), pa.array([keys[x:y].tobytes() for x, y in part], pa.binary()),
                    pa.array([codes[x:y].tobytes() for x, y in part], pa.binary())], ["block", "keys", "codes"])

        for batch in batches:
            for a, b, sets, first in shingle_sets(batch.column(0), words):
                lo, _ = set_codes(sets, first)
                n = np.diff(first)
                hot = np.zeros(len(sets), bool)
                if len(common):
                    at = np.minimum(np.searchsorted(common, sets), len(common) - 1)
                    hot = common[at] == sets
                take = n - -(-percent * n // 100) + 1
                # Places in the order "rare groups by hash, then common groups by hash".
                text = np.repeat(np.arange(b - a), n)
                cold = np.concatenate(([0], np.cumsum(~hot)))
                rare = (cold[first[1:]] - cold[first[:-1]])[text]
                rank_cold = cold[:-1] - cold[first[:-1]][text]
                place = np.where(hot, rare + np.arange(len(sets)) - first[:-1][text] - rank_cold, rank_cold)
                # A set this task has entered, as far as the table remembers, is not entered again.
                fresh = np.zeros(b - a, bool)
                fresh[np.unique(lo, return_index=True)[1]] = True
                slot = lo & (SEEN - 1)
                fresh &= seen[slot] != lo
                seen[slot] = lo
                pick = (place < take[text]) & fresh[text]
                held.append((K.mix(sets[pick]), lo[text[pick]], hot[pick]))
                size += int(pick.sum())
                if size >= GATHERED:
                    yield from dealt()
                    held, size = [], 0
        if size:
            yield from dealt()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """(key, lo) of the keys of a block that two different sets hold; of common keys all."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int64)
    order = np.lexsort((codes, keys))
    keys, codes = keys[order], codes[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1]))
    keys, codes = keys[new], codes[new]
    if table.column("block")[0].as_py() % 2 == 0:
        same = keys[1:] == keys[:-1]
        keep = np.append(same, False) | np.append(False, same)
        keys, codes = keys[keep], codes[keep]
    return pa.table({"key": keys.view(np.int64), "lo": codes})


class CountTree:
    """An R-tree over the count vectors of a region's nodes, packed by size and counts."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        order = np.lexsort((counts.argmax(axis=1), sizes))
        self.order, self.counts, self.sizes, self.comps = order, counts[order].astype(np.int64), sizes[order], comps[order]
        #: Levels from the leaves up: largest counts, least size and only component (or -1) of each box.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, least, comp, step = self.counts, self.sizes, self.comps, LEAF
        while True:
            at = np.arange(0, len(least), step)
            low, high = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            top, least, comp = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.where(low == high, low, -1)
            self.levels.append((top, least, comp))
            step = FANOUT
            if len(least) == 1:
                break

    def rows(self, leaf: int) -> slice:
        return slice(leaf * LEAF, min(len(self.sizes), (leaf + 1) * LEAF))


def tree_join(left: CountTree, right: CountTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in left, places in right) of pairs of different components whose summed minima reach the overlap they need."""
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    same = left is right
    while stack:
        i, a, j, b = stack.pop()
        (top_a, least_a, comp_a), (top_b, least_b, comp_b) = left.levels[i], right.levels[j]
        if comp_a[a] >= 0 and comp_a[a] == comp_b[b]:
            continue
        if np.minimum(top_a[a], top_b[b]).sum() < least_overlap(least_a[a], least_b[b], percent):
            continue
        if i == 0 and j == 0:
            x, y = left.rows(a), right.rows(b)
            bound = np.minimum(left.counts[x][:, None, :], right.counts[y][None]).sum(axis=2)
            ok = bound >= least_overlap(left.sizes[x][:, None], right.sizes[y][None], percent)
            ok &= left.comps[x][:, None] != right.comps[y][None]
            p, q = np.nonzero(ok)
            if len(p):
                yield left.order[p + x.start], right.order[q + y.start]
        elif i >= j:
            below = range(a * FANOUT, min((a + 1) * FANOUT, len(left.levels[i - 1][1])))
            if same and i == j:
                stack.extend((i - 1, k, j - 1, m) for k in below for m in below if k <= m) if a == b else stack.extend(
                    (i - 1, k, j - 1, m) for k in below for m in range(b * FANOUT, min((b + 1) * FANOUT, len(right.levels[j - 1][1]))))
            else:
                stack.extend((i - 1, k, j, b) for k in below)
        else:
            stack.extend((i, a, j - 1, k) for k in range(b * FANOUT, min((b + 1) * FANOUT, len(right.levels[j - 1][1]))))


def _candidates(percent: int):
    """Pairs of nodes of a block's regions that pass the bound."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, n = (table.column(c).to_numpy() for c in ("node", "comp", "n"))
        region, part = table.column("key").to_numpy(), table.column("own").to_numpy()
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        counts = unpacked(table.column("counts").to_pylist())
        order = np.lexsort((node, j, i, region))
        new = np.append(True, (np.diff(region[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0))
        at = np.append(np.flatnonzero(new), len(order))
        size = np.diff(at)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        two = np.flatnonzero(size == 2)
        if len(two):
            p, q = order[at[two]], order[at[two] + 1]
            bound = np.minimum(counts[p], counts[q]).sum(axis=1, dtype=np.int64)
            ok = (bound >= least_overlap(n[p], n[q], percent)) & (comp[p] != comp[q])
            out.append((node[p[ok]], node[q[ok]]))
        for k in np.flatnonzero(size > 2).tolist():
            rows = order[at[k] : at[k + 1]]
            if i[rows[0]] == j[rows[0]]:
                left = right = CountTree(counts[rows], n[rows], comp[rows])
                x = y = rows
            else:
                x, y = rows[part[rows] == i[rows[0]]], rows[part[rows] == j[rows[0]]]
                if not len(x) or not len(y):
                    continue
                left, right = CountTree(counts[x], n[x], comp[x]), CountTree(counts[y], n[y], comp[y])
            out.extend((node[x[p]], node[y[q]]) for p, q in tree_join(left, right, percent))
        a = np.concatenate([p for p, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([q for _, q in out]) if out else np.zeros(0, np.int64)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _verifier(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(a), bool)
            known: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
            for s, e, sets, first in shingle_sets(batch.column(3), words):
                for k in range(s, e):
                    if known[0] != a[k]:
                        (_, _, one, _), = shingle_sets(batch.column(2).slice(k, 1), words)
                        known = int(a[k]), one
                    other = sets[first[k - s] : first[k - s + 1]]
                    shared = len(np.intersect1d(known[1], other, assume_unique=True))
                    ok[k] = 100 * shared >= percent * (len(known[1]) + len(other) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return run


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, text, n, fine) of the wanted nodes, stored; fine is the finer count vector."""
    wanted = stored(wanted.distinct().join(nodes.select("node", "rep", "n", "lo", "hi"), "node"), "jaccard-wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    # A document's id may be repeated with another text, so the set is compared too.
    found = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("node", "text", "n", "lo", "hi")

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, first in shingle_sets(batch.column(1), words):
                lo, hi = set_codes(sets, first)
                n = np.diff(first)
                part = batch.slice(a, b - a)
                same = (n == part.column(2).to_numpy()) & (lo == part.column(3).to_numpy()) & (hi == part.column(4).to_numpy())
                cell = np.repeat(np.arange(b - a), n) * FINE + (sets % np.uint64(FINE)).astype(np.int64)
                counts = np.bincount(cell, minlength=(b - a) * FINE).reshape(b - a, FINE)
                # A count that a byte cannot hold leaves the vector out: no bound then.
                fine = [c.astype(np.uint8).tobytes() if c.max() < 256 else b"" for c in counts]
                keep = pa.array(same)
                yield pa.RecordBatch.from_arrays(
                    [x.filter(keep) for x in (part.column(0), part.column(1), part.column(2), pa.array(fine, pa.binary()))], ["node", "text", "n", "fine"])

    texts = stored(found.mapInArrow(right, "node long, text string, n long, fine binary"), "jaccard-texts").dropDuplicates(["node"])
    return stored(texts, "jaccard-texts")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts' sets reach the threshold."""
    fine_a = texts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("fine").alias("fine_a"))
    fine_b = texts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("fine").alias("fine_b"))
    bounded = pairs.join(fine_a, "a").join(fine_b, "b").select("a", "b", "n_a", "n_b", "fine_a", "fine_b")
    left = stored(bounded.mapInArrow(_finer_bound(percent), "a long, b long"), "jaccard-bounded")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_verifier(words, percent), "a long, b long"), "jaccard-links")


def _finer_bound(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                a, b, n_a, n_b = (part.column(k).to_numpy() for k in range(4))
                x, y = part.column(4).to_pylist(), part.column(5).to_pylist()
                ok = np.array([not (p and q) for p, q in zip(x, y, strict=True)], bool)
                rows = np.flatnonzero(~ok)
                if len(rows):
                    p, q = (np.frombuffer(b"".join(v[k] for k in rows), np.uint8).reshape(-1, FINE) for v in (x, y))
                    ok[rows] = np.minimum(p, q).sum(axis=1, dtype=np.int64) >= least_overlap(n_a[rows], n_b[rows], percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return run


def spread_labels(edges: DataFrame, steps: int = 3) -> DataFrame:
    """(node, root): the smallest node within ``steps`` edges (a, b).

    Nodes of one root are connected, but not all connected nodes share one;
    that is enough to leave out pairs, and takes no search for a fixed point.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    for _ in range(steps - 1):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        labels = near.select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    return labels


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, links): (doc_id, n_shingles, component_id) of every row, and verified links of document ids.

    links join representatives of equal sets and span every component; they are
    not all linked pairs. NULL and wordless texts have 0 shingles and are linked
    with nothing: component_id is their own id. Rows with a NULL id take the
    component of equal sets with an id, else NULL. Rows that repeat an id count
    each; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = stored(docs.mapInArrow(_signatures(words), _SIGNED), "jaccard-signatures")
    signed = parts.filter("shingle IS NULL").drop("shingle", "held")
    total = signed.agg(F.sum("n")).first()[0] or 0
    often = parts.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("held").alias("held"))
    often = often.filter(F.col("held") > max(COMMON, total // COMMON_SHARE)).select("shingle").toArrow()
    common = np.sort(often.column(0).to_numpy().view(np.uint64))
    nodes = stored(
        signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "lo", "hi")
        .agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins"), F.first("counts").alias("counts"))
        .withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")

    # Near copies meet leaders first: of each min-hash group one member, another in each round, and only members
    # of other components than the leader's are paired with it.
    groups = nodes.select("node", F.posexplode("mins").alias("k", "m"))
    many = stored(groups.groupBy("k", "m").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k", "m"), "jaccard-buckets")
    groups = stored(groups.join(many, ["k", "m"]), "jaccard-grouped")
    texts = _texts(groups.select("node"), nodes, docs, words)
    near, comps = None, spark.createDataFrame([], "node long, root long")
    for number in range(ROUNDS):
        own = groups.join(comps, "node", "left").select("k", "m", "node", F.coalesce("root", "node").alias("comp"))
        leader = F.min(F.struct(F.xxhash64("node", F.lit(number)), "node", "comp")).alias("l")
        leaders = own.groupBy("k", "m").agg(leader, F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
        leaders = stored(leaders.select("k", "m", F.col("l.node").alias("a"), F.col("l.comp").alias("other")), "jaccard-leaders")
        pairs = own.join(leaders, ["k", "m"]).filter("comp <> other").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        found = _verified(stored(pairs.distinct(), "jaccard-pairs"), texts, words, percent)
        near = found if near is None else near.unionByName(found)
        comps = stored(spread_labels(near), "jaccard-comps")
    placed = stored(
        nodes.select("node", "lo", "n").join(comps, "node", "left").select("node", "lo", "n", F.coalesce("root", "node").alias("comp")), "jaccard-placed")

    blocks = max(256, 1 << (int(total) // (4 * SHARE)).bit_length())
    entered = docs.select("text").mapInArrow(_regions(words, percent, common, blocks), "block long, keys binary, codes binary")
    shared = stored(entered.groupBy("block").applyInArrow(_shared, "key long, lo long"), "jaccard-regions")
    members = stored(shared.join(placed, "lo").select("key", "node", "n", "comp"), "jaccard-members")
    mixed = stored(members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size")).filter("x <> y").select("key", "size"), "jaccard-mixed")
    cut = F.ceil(F.col("size") / REGION)
    own = F.pmod(F.xxhash64("node"), F.col("cut"))
    dealt = members.join(mixed, "key").withColumn("cut", cut).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    dealt = dealt.select("key", "node", "n", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(
        nodes.select("node", "counts"), "node").withColumn("block", F.pmod(F.xxhash64("key", "i", "j"), F.lit(blocks)))
    pairs = stored(dealt.groupBy("block").applyInArrow(_candidates(percent), "a long, b long").distinct(), "jaccard-pairs")
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, docs, words)
    links = near.unionByName(_verified(pairs, texts, words, percent))

    groups = connected_components(links).join(nodes.select("node", "rep"), "node")
    least = stored(groups.groupBy("root").agg(F.min("rep").alias("least")), "jaccard-groups")
    named = groups.join(least, "root").select("node", "least")
    classes = stored(nodes.join(named, "node", "left").select("n", "lo", "hi", F.coalesce("least", "rep").alias("least")), "jaccard-classes")
    out = signed.select("doc_id", "n", "lo", "hi").join(classes, ["n", "lo", "hi"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    ids = nodes.select("node", "rep")
    named = links.join(ids.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b")
    return out, named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
