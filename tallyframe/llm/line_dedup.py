"""Removal of repeated runs of lines, found by winnowing over line hashes.

Lines are compared with white space evened out. From every line on, the shortest window of
lines that holds ``min_words`` words is taken, and the smallest line hash in it (the leftmost of equals) is selected.
A run of at least ``min_words`` words contains such a window, so two copies of
it select the same line: a guaranteed fingerprint. Each fingerprint is joined
with its first position in the corpus, the match is extended both ways as far
as lines agree, and where it spans at least ``min_words`` words the later run
is deleted. Documents are ordered by id, then by their text's MD5.

Where a selected line stands in another context at its first position, the
windows around it that are not matched there are grouped by their whole
content, and all but the first of a group are deleted too. So a line goes
exactly if it lies in a run of ``min_words`` words that occurs earlier.

Only first positions are joined, never all pairs, so a line that a third of
all documents hold costs one row for each of them, and a window one for each place.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored

MIN_WORDS = 20
#: Line comparisons up to which matches are extended line by line.
MANY = 20_000


def line_keys(text: str) -> tuple[list[int], list[bytes], list[int]]:
    """(line numbers, hashes, word counts) of the lines that hold words."""
    places, keys, words = [], [], []
    for n, line in enumerate(text.encode("utf-8").split(b"\n")):
        parts = line.split()
        if parts:
            places.append(n)
            keys.append(hashlib.md5(b" ".join(parts), usedforsecurity=False).digest())
            words.append(len(parts))
    return places, keys, words


def winnow(keys: list[bytes], words: list[int], min_words: int) -> list[int]:
    """Places of the smallest hash in each shortest window of ``min_words`` words."""
    picks: list[int] = []
    end, held = 0, 0
    best = -1
    for start in range(len(keys)):
        while end < len(keys) and held < min_words:
            held += words[end]
            end += 1
        if held < min_words:
            break
        if best < start or end - start == 1:
            best = min(range(start, end), key=lambda k: (keys[k], k))
        else:
            best = min(range(best, end), key=lambda k: (keys[k], k))
        if not picks or picks[-1] != best:
            picks.append(best)
        held -= words[start]
    return picks


def _signatures(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("tkey", pa.string()), ("places", pa.list_(pa.int32())),
                          ("keys", pa.list_(pa.binary())), ("words", pa.list_(pa.int32())), ("picks", pa.list_(pa.int32()))])
        for batch in batches:
            ids, tkeys, texts = batch.columns
            for a in range(0, len(ids), 512):
                out = []
                for i, t, x in zip(ids.slice(a, 512).to_pylist(), tkeys.slice(a, 512).to_pylist(), texts.slice(a, 512).to_pylist(), strict=True):
                    places, keys, words = line_keys(x)
                    if picks := winnow(keys, words, min_words):
                        out.append({"doc_id": i, "tkey": t, "places": places, "keys": keys, "words": words, "picks": picks})
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def extended(keys: list[bytes], source: list[bytes], at: int, there: int) -> tuple[int, int]:
    """The longest run around a match: first place and the place after the last."""
    a = b = 0
    while at - a > 0 and there - a > 0 and keys[at - a - 1] == source[there - a - 1]:
        a += 1
    while at + b < len(keys) and there + b < len(source) and keys[at + b] == source[there + b]:
        b += 1
    return at - a, at + b


def _block_ranks(lines: np.ndarray) -> list[np.ndarray]:
    """For each power of two a number per place that tells the blocks of so many lines starting there apart."""
    levels = [lines]
    while 2 << len(levels) <= len(lines):
        size = 1 << (len(levels) - 1)
        last = levels[-1].astype(np.int64)
        pair = last[:-size] * (int(last.max()) + 1) + last[size:]
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
    return levels


def _many_extended(keys: list[bytes], source: list[bytes], ats: np.ndarray, theres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``extended`` for many matches: each end is found in steps of powers of two."""
    ids: dict[bytes, int] = {}
    both = [ids.setdefault(k, len(ids)) for k in keys] + [-1] + [ids.setdefault(k, len(ids)) for k in source]
    lines = np.array(both, np.int32)
    lines[len(keys)] = len(ids)  # a line of its own between the two
    levels = _block_ranks(lines)
    end, other = ats.copy(), theres + len(keys) + 1
    start, before = ats.copy(), other.copy()
    for size, rank in reversed([(1 << j, r) for j, r in enumerate(levels)]):
        fits = np.flatnonzero((end + size <= len(lines)) & (other + size <= len(lines)))
        fits = fits[rank[end[fits]] == rank[other[fits]]]
        end[fits] += size
        other[fits] += size
        fits = np.flatnonzero((start >= size) & (before >= size))
        fits = fits[rank[start[fits] - size] == rank[before[fits] - size]]
        start[fits] -= size
        before[fits] -= size
    return start, end


def spans(keys: list[bytes], source: list[bytes], ats: list[int], theres: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``extended`` for each match.

    Texts with many matches, as repeated lines make them, look each end up in
    block ranks; the work then grows with the lines and matches, not with their product.
    """
    if len(ats) * min(len(keys), len(source)) > MANY:
        return _many_extended(keys, source, np.array(ats), np.array(theres))
    last: dict[int, tuple[int, int]] = {}
    out = np.zeros((2, len(ats)), np.int64)
    for at, there, k in sorted(zip(ats, theres, range(len(ats)), strict=True)):
        if at >= last.get(at - there, (0, 0))[1]:
            last[at - there] = extended(keys, source, at, there)
        out[:, k] = last[at - there]
    return out[0], out[1]


def marked(words: list[int], lo: np.ndarray, hi: np.ndarray, min_words: int) -> np.ndarray:
    """Marks of the lines in any of the spans that holds ``min_words`` words."""
    upto = np.concatenate(([0], np.cumsum(words)))
    enough = upto[hi] - upto[lo] >= min_words
    depth = np.bincount(lo[enough], minlength=len(words) + 1) - np.bincount(hi[enough], minlength=len(words) + 1)
    return np.cumsum(depth)[:-1] > 0


def matched(keys: list[bytes], source: list[bytes], words: list[int], ats: list[int], theres: list[int], min_words: int) -> np.ndarray:
    """Marks of the lines in a run around any match that spans ``min_words`` words."""
    return marked(words, *spans(keys, source, ats, theres), min_words)


def unmatched(keys: list[bytes], words: list[int], ats: list[int], lo: np.ndarray, hi: np.ndarray, min_words: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of the windows of the selected lines ``ats`` that reach out of the line's span.

    Windows are the shortest of ``min_words`` words, from every line forwards and backwards: within a run
    of so many words they cover all its lines, and two copies of it hold the same ones. Each belongs to
    the line selected in the shortest window from its start. If it does not reach out of the span, it
    stands at the line's first position too, and all its copies are matched there.
    """
    upto = list(itertools.accumulate(words, initial=0))
    for at, low, high in zip(ats, lo.tolist(), hi.tolist(), strict=True):
        left, right = at, at + 1
        while left > 0 and at - left < min_words and keys[left - 1] > keys[at]:
            left -= 1
        while right < len(keys) and right - at < min_words and keys[right] >= keys[at]:
            right += 1
        for start in range(left, at + 1):
            end = bisect.bisect_left(upto, upto[start] + min_words)
            if not at < end <= right:
                continue  # another line is selected in it
            last = end
            while last == end or last < len(upto) and upto[last] - upto[start + 1] < min_words:
                if start < low or last > high:
                    yield start, last
                last += 1


def _runs(min_words: int):
    """Rows without a key hold the lines matched with one source, the others a window that is not matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("tkey", pa.string()), ("key", pa.binary()), ("at", pa.int32()), ("gone", pa.list_(pa.int32()))])
        names = ("doc_id", "tkey", "keys", "source", "words", "places", "ats", "theres")
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                r = {n: batch.column(n)[row].as_py() for n in names}
                keys, places = r["keys"], np.array(r["places"])
                own = {"doc_id": r["doc_id"], "tkey": r["tkey"]}
                lo, hi = spans(keys, r["source"], r["ats"], r["theres"])
                gone = marked(r["words"], lo, hi, min_words)
                if gone.any():
                    out.append(own | {"gone": places[gone].tolist()})
                for a, b in unmatched(keys, r["words"], r["ats"], lo, hi, min_words):
                    key = hashlib.md5(b"".join(keys[a:b]), usedforsecurity=False).digest()
                    out.append(own | {"key": key, "at": a, "gone": places[a:b].tolist()})
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=kind)
                        out = []
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def _firsts(marks: DataFrame, purpose: str) -> DataFrame:
    """(key, first) of the keys with more than one spot.

    Stored, so that the join with the marks stands alone in its stage and AQE can split a key that very many documents hold.
    """
    ends = marks.groupBy("key").agg(F.min("spot").alias("first"), F.max("spot").alias("final"))
    return stored(ends.filter("first <> final").select("key", "first"), purpose)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tkey, gone): line numbers to delete, for documents that lose any; tkey is the text's MD5."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("tkey"), F.col("text").alias("text")).filter("text IS NOT NULL")
    signed = stored(texts.mapInArrow(
        _signatures(min_words), "doc_id long, tkey string, places array<int>, keys array<binary>, words array<int>, picks array<int>"
    ), "line-signatures")
    spot = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey", "at")
    marks = signed.select("doc_id", "tkey", F.explode("picks").alias("at"), "keys").select(
        F.expr("keys[at]").alias("key"), spot.alias("spot"))
    anchors = marks.join(_firsts(marks, "line-firsts"), "key").filter("spot <> first").select(
        F.col("spot.doc_id").alias("doc_id"), F.col("spot.tkey").alias("tkey"), F.col("first.doc_id").alias("src_id"),
        F.col("first.tkey").alias("src_tkey"), F.col("spot.at").alias("at"), F.col("first.at").alias("there"))
    pairs = anchors.groupBy("doc_id", "tkey", "src_id", "src_tkey").agg(F.collect_set(F.struct("at", "there")).alias("m"))
    # Rows that repeat an id and a text are one document.
    once = signed.dropDuplicates(["doc_id", "tkey"])
    source = once.select(F.col("doc_id").alias("s_id"), F.col("tkey").alias("s_tkey"), F.col("keys").alias("source"))
    own = once.select(F.col("doc_id").alias("o_id"), F.col("tkey").alias("o_tkey"), "places", "keys", "words")
    joined = (
        pairs.join(source, F.col("src_tkey").eqNullSafe(F.col("s_tkey")) & F.col("src_id").eqNullSafe(F.col("s_id")))
        .join(own, F.col("tkey").eqNullSafe(F.col("o_tkey")) & F.col("doc_id").eqNullSafe(F.col("o_id")))
        .select("doc_id", "tkey", F.col("m.at").alias("ats"), F.col("m.there").alias("theres"), "places", "keys", "words", "source")
    )
    found = stored(joined.mapInArrow(_runs(min_words), "doc_id long, tkey string, key binary, at int, gone array<int>"), "line-runs")
    rest = found.filter("key IS NOT NULL").select("key", spot.alias("spot"), "gone")
    later = rest.join(_firsts(rest, "window-firsts"), "key").filter("spot <> first").select("spot.doc_id", "spot.tkey", "gone")
    gone = found.filter("key IS NULL").select("doc_id", "tkey", "gone").unionByName(later)
    return gone.groupBy("doc_id", "tkey").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``; adds n_lines (before) and n_removed.

    Lines without words take no part and stay. Rows that repeat an id and a
    text lose the same lines; NULL ids come last in the order; a NULL text
    stays NULL with 0 lines, an empty one is one line. All other columns are
    passed through; columns named n_lines or n_removed are replaced.
    """
    gone = repeated_lines(docs, min_words).select(
        F.col("doc_id").alias("_gone_id"), F.col("tkey").alias("_gone_key"), F.col("gone").alias("_gone"))
    base = docs.drop("n_lines", "n_removed")
    joined = base.withColumn("_key", F.md5("text")).join(
        gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left")
    lines = F.split("text", "\n")
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')")
    return (
        joined.withColumn("_lines", lines)
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long"))
        .withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
        .select(*base.columns, "n_lines", "n_removed")
    )
