"""Benchmark decontamination by a prefix-filtered join of word windows.

An item's windows are its runs of ``window`` words (a shorter item is one
window). The words of all documents are counted, which gives the order by
rarity. To contain a window whole, a text must contain its rarest shingle, so
the necessary prefix is that one token: the texts' shingles are joined with
the windows' rarest shingles, the offset of the shingle in the window must
leave room before and after it within the text (length and position bounds),
and what remains is compared word by word over the whole window.

The items are dealt into blocks of bounded size, each of which travels to the
tasks over all documents; one small item set is one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textkit as K
from tallyframe.llm.common import stored

WINDOW = 13
#: Words of a shingle; a shorter window has its own length.
SHINGLE = 3
#: Bytes of item text in one block.
BLOCK_BYTES = 8 << 20


def item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts and each text's first word."""
    column = pa.array([t or "" for t in texts], pa.large_string())
    words, sizes = [], []
    for _, _, data, off in K.text_chunks(column):
        folded = K.FOLD[data]
        starts, ends, first = K.word_spans(folded, off, K.ALNUM)
        words.append(K.span_hashes(folded, starts, ends))
        sizes.append(np.diff(first))
    joined = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return joined, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, and the places of their first words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = words[:n].copy()
    for k in range(1, size):
        code = code * np.uint64(0x9FB21C651E98DF25) + words[k : n + k]
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + size <= end[:n])
    return K.mix(code[at] + np.uint64(size)), at


class WindowIndex:
    """The windows of a block of items, each entered under its rarest shingle."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int = WINDOW, shingle: int = SHINGLE):
        words, first = item_words(texts)
        distinct: dict[bytes, set[int]] = {}
        for k, item in enumerate(ids):
            own = words[first[k] : first[k + 1]]
            size = min(window, len(own))
            for a in range(len(own) - size + 1 if size else 0):
                distinct.setdefault(own[a : a + size].tobytes(), set()).add(item)
        self.windows = [np.frombuffer(w, np.uint64) for w in distinct]
        self.items = [sorted(s) for s in distinct.values()]
        self.shingle = shingle
        self.tokens: dict[int, list[np.ndarray]] = {}
        self.sizes = sorted({min(shingle, len(w)) for w in self.windows})
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        if not self.windows:
            return
        self.codes = []  # each window's shingle hashes, by offset
        for w in self.windows:
            self.codes.append(shingles(w, np.array([0, len(w)]), min(shingle, len(w)))[0])
        self.vocabulary = np.unique(np.concatenate(self.codes))

    def count(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often the texts hold each shingle of the vocabulary."""
        total = np.zeros(len(self.vocabulary), np.int64)
        for size in self.sizes:
            code, _ = shingles(words, first, size)
            at = np.minimum(np.searchsorted(self.vocabulary, code), len(self.vocabulary) - 1)
            total += np.bincount(at[self.vocabulary[at] == code], minlength=len(total))
        return total

    def order(self, counts: np.ndarray) -> None:
        """Enter each window under the shingle the documents hold least often; ties go to the smaller hash."""
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for k, code in enumerate(self.codes):
            place = np.searchsorted(self.vocabulary, code)
            o = int(np.lexsort((code, counts[place]))[0])
            size = min(self.shingle, len(self.windows[k]))
            entries.setdefault(size, []).append((int(code[o]), o, k))
        for size, rows in entries.items():
            rows.sort()
            self.by_size[size] = (
                np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            )
        # Most shingles stop at this table of their leading bits.
        self.seen = {s: np.zeros(1 << 20, bool) for s in self.by_size}
        for s, (codes, _, _) in self.by_size.items():
            self.seen[s][(codes >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places where windows begin, window numbers), verified."""
        for size, (tokens, offsets, numbers) in self.by_size.items():
            code, at = shingles(words, first, size)
            maybe = np.flatnonzero(self.seen[size][(code >> np.uint64(44)).astype(np.int64)])
            code, at = code[maybe], at[maybe]
            lo, hi = np.searchsorted(tokens, code, "left"), np.searchsorted(tokens, code, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            many = (hi - lo)[hit]
            entry = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            place, window = np.repeat(at[hit], many) - offsets[entry], numbers[entry]
            length = np.array([len(w) for w in self.windows])[window]
            text = np.searchsorted(first, np.repeat(at[hit], many), "right") - 1
            room = (place >= first[text]) & (place + length <= first[text + 1])
            place, window, length = place[room], window[room], length[room]
            for n in np.unique(length).tolist():
                mine = length == n
                p, w = place[mine], window[mine]
                if not hasattr(self, f"_flat{n}"):
                    rows = [k for k, x in enumerate(self.windows) if len(x) == n]
                    back = np.zeros(len(self.windows), np.int64)
                    back[rows] = np.arange(len(rows))
                    setattr(self, f"_flat{n}", (back, np.array([self.windows[k] for k in rows])))
                back, flat = getattr(self, f"_flat{n}")
                same = (words[p[:, None] + np.arange(n)] == flat[back[w]]).all(axis=1)
                yield p[same], w[same]


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, off in K.text_chunks(column):
        folded = K.FOLD[data]
        starts, ends, first = K.word_spans(folded, off, K.ALNUM)
        yield a, b, K.span_hashes(folded, starts, ends), first


def _counted(docs: DataFrame, index: WindowIndex) -> np.ndarray:
    """Counts of the block's shingles over all documents; their number is bounded by the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            for _, _, words, first in _words(batch.column(0)):
                total += index.count(words, first)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    counts = np.zeros(len(index.vocabulary), np.int64)
    found = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    for r in found.toLocalIterator():
        counts[r["k"]] = r["n"]
    return counts


def _hits(docs: DataFrame, index: WindowIndex) -> DataFrame:
    """(row, doc_id, n_words, spans, items) of every row: merged spans of hit words, and the items found."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, first in _words(batch.column(2)):
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[int]] = {}
                for place, window in index.matches(words, first):
                    text = np.searchsorted(first, place, "right") - 1
                    for p, w, d in zip(place.tolist(), window.tolist(), text.tolist(), strict=True):
                        p -= int(first[d])
                        spans.setdefault(d, []).append((p, p + len(index.windows[w])))
                        items.setdefault(d, set()).update(index.items[w])
                flat = [[x for s in merged(spans.get(d, [])) for x in s] for d in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(first)),
                     pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(items.get(d, ())) for d in range(b - a)], pa.list_(pa.int64()))],
                    ["row", "doc_id", "n_words", "spans", "items"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(
        find, "row long, doc_id long, n_words long, spans array<long>, items array<long>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) of every document row.

    A word within any occurrence of an item's window is hit; a text is
    contaminated when hits make up at least a twentieth of its words. spans
    are word places, start and end in turn. NULL texts have no words and match
    nothing; items without words, NULL items and NULL item ids match nothing;
    repeated items count once; without items nothing is hit. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = None
    for number in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        index = WindowIndex([r["item_id"] for r in some], [r["text"] for r in some], window, shingle)
        if index.windows:
            index.order(_counted(rows, index))
        hits = _hits(rows, index)
        if blocks > 1:
            hits = stored(hits, "decontamination")
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy("row", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    schema = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
              "items array<long>, spans array<long>")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans = merged(list(zip(r["spans"][::2], r["spans"][1::2], strict=True)))
                hit = sum(b - a for a, b in spans)
                names = ",".join(sorted(map(str, r["items"])))
                out.append({
                    "doc_id": r["doc_id"], "n_words": r["n_words"], "n_hit": hit, "n_items": len(r["items"]),
                    "items_sha256": hashlib.sha256(names.encode()).hexdigest(),
                    "contaminated": hit > 0 and 20 * hit >= r["n_words"], "items": r["items"], "spans": [x for s in spans for x in s],
                })
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
                ("contaminated", pa.bool_()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64()))]))

    return found.mapInArrow(digest, schema)
