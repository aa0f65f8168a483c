"""Phrase collocations from an FM-index per shard over word ids.

The words of each language are cut into shards of bounded size. A shard's
index is the Burrows-Wheeler transform of its word ids, with suffixes sorted
to the depth of the longest phrase. A phrase is an interval of the sorted
suffixes: a left extension by a word is the LF image of the interval's rows
that hold this word, a right extension is a part of the interval. Phrases
are enumerated one word longer at a time; an extension is followed only if it
lies in an interval of its own first words as well, so both its first and its
last words have passed before.

Counts are summed across shards after every length, over 128-bit hashes, and
only phrases that reach ``least`` go on, so rare phrases are never followed
further. A tally goes ahead of the hashes: every shard adds its counts up by
place, the hash modulo a number of places that grows with the words, and only
phrases whose place reaches ``least`` over all shards send their hashes. A
place counts at least what each of its phrases does, so none is lost. The
hashes that pass return to the shards as a bitmap of bounded
size, which may let some rare phrases by, or by a join if they are too many for
it. A shard's intervals travel as one packed row, and of the shards that hold a
phrase one spells it out.

The index is a table bucketed by shard, so that it stays where it is while the
intervals of each length are brought to it; a task works on one shard at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import textkit as K
from tallyframe.llm.common import stored
from tallyframe.session import shared_dir

#: Words of a shard; a piece is never cut, so one longer piece makes a longer shard.
SHARD_WORDS = 1 << 18
#: Words a task holds over all languages before it closes its largest shard.
HELD_WORDS = 1 << 20
LONGEST, LEAST, TOP = 5, 100, 2000
#: Slots over which a language's phrases are ranked before they meet.
SLOTS = 64
#: Places of the map of hashes that pass, as a power of two; it is used for up to an eighth as many hashes.
MAP_BITS = 25
#: Keys a task holds while it adds counts up.
HELD_KEYS = 1 << 18
#: Ranges of places, and of keys, whose counts meet in one task, and the least and most places, as powers of two.
#: Beyond the most, more rare phrases share a place with others and are sent, but none is lost.
RANGES, FEWEST_BITS, MOST_BITS = 512, 16, 27
NO_LANGUAGE = "und"

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: Bytes of a word: no blank, no tab, no end of a piece.
_WORD = ~_PIECE_END
_WORD[[0x20, 0x09]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Changes the bytes of a word for its second hash.
_OTHER = np.uint8(0x5A)


# --- the index of one shard ----------------------------------------------------

def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 to 2 ** 32 - 1, by their 16-bit halves, which numpy sorts in linear time."""
    out = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() >> 16:
        out = out[np.argsort((values >> 16).astype(np.uint16)[out], kind="stable")]
    return out


@dataclass
class FmIndex:
    """Transform of a text of ids 1..size, with 0 between pieces; suffixes are sorted by ``depth`` ids."""

    bwt: np.ndarray
    size: int

    def __post_init__(self):
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.bwt, minlength=self.size + 1))))
        #: The row of the suffix one id later; the inverse maps a row to that of the suffix one id earlier.
        self.next_row = _order(self.bwt).astype(np.int32)
        self.earlier = np.empty_like(self.next_row)
        self.earlier[self.next_row] = np.arange(len(self.bwt), dtype=np.int32)

    @staticmethod
    def of(text: np.ndarray, size: int, depth: int = LONGEST) -> FmIndex:
        """``text`` starts and ends with 0."""
        n = len(text)
        padded = np.concatenate((text.astype(np.int64), np.zeros(depth, np.int64)))
        rank, width = padded, 1
        while width < depth:
            step = min(width, depth - width)  # ranks of ``width`` ids, continued by those ``step`` later
            after = np.concatenate((rank[step:], np.zeros(step, np.int64)))
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            width += step
        order = _order(rank[:n])
        return FmIndex(text[order - 1].astype(np.int32), size)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the one-word intervals; word k is at place k - 1."""
        return self.first[1:-1], np.diff(self.first)[1:]

    def left(self, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions by one word before, in rising order of their starts: (interval extended, word, start, size).

        The intervals are disjoint and rise, so the LF images of their rows, put
        at their places, lie in order of word and interval without a sort.
        """
        owner = np.repeat(np.arange(len(lo), dtype=np.int32), count)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        word = self.bwt[rows]
        inside = word > 0
        image = self.earlier[rows[inside]]
        owners, words = np.full(len(self.bwt), -1, np.int32), np.zeros(len(self.bwt), np.int32)
        owners[image], words[image] = owner[inside], word[inside]
        at = np.flatnonzero(owners >= 0)
        owner, word = owners[at].astype(np.int64), words[at].astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])))) if len(at) else at
        return owner[begin], word[begin], at[begin], np.diff(np.append(begin, len(at)))

    def within(self, lo: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Marks of the rows ``lo`` that lie in one of the disjoint intervals, which rise."""
        if not len(starts):
            return np.zeros(len(lo), bool)
        at = np.searchsorted(starts, lo, "right") - 1
        return (at >= 0) & (lo < starts[np.maximum(at, 0)] + sizes[np.maximum(at, 0)])

    def spelled(self, lo: np.ndarray, length: int) -> list[np.ndarray]:
        """The ids of phrases of ``length`` words, first words first."""
        out = []
        for _ in range(length):
            out.append(np.searchsorted(self.first, lo, "right") - 1)
            lo = self.next_row[lo]
        return out


def extended(index: FmIndex, length: int, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extensions of the phrases of ``length`` words whose first words are among them too: (phrase extended, word, start, size)."""
    if not length:
        start, size = index.words()
        return np.zeros(len(start), np.int64), np.arange(1, len(start) + 1), start, size
    order = np.argsort(lo, kind="stable")
    lo, count = lo[order], count[order]
    owner, word, start, size = index.left(lo, count)
    keep = index.within(start, lo, count)
    return order[owner[keep]], word[keep], start[keep], size[keep]


# --- building shards -----------------------------------------------------------

class _Shard:
    """Words of one language on their way into an index."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.opens: list[np.ndarray] = []
        self.size = 0

    def add(self, words: pa.Array, opens: np.ndarray) -> None:
        self.words.append(words)
        self.opens.append(opens)
        self.size += len(words)

    def row(self, shard: int, lang: str, depth: int) -> dict:
        coded = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
        opens = np.concatenate(self.opens)
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        text = np.zeros(len(ids) + int(opens.sum()) + 1, np.int64)
        text[np.arange(len(ids)) + np.cumsum(opens)] = ids  # a 0 before each word that opens a piece
        index = FmIndex.of(text, len(coded.dictionary), depth)
        vocabulary = b" ".join(coded.dictionary.cast(pa.binary()).to_pylist())
        return {"shard": shard, "lang": lang, "n_words": len(ids), "bwt": index.bwt.tobytes(), "vocabulary": vocabulary}


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts, marks of those that open a piece, and each text's first word."""
    folded = K.FOLD[data]
    starts, ends, first = K.word_spans(folded, offsets, _WORD)
    ended = np.cumsum(_PIECE_END[folded])
    opens = np.ones(len(starts), bool)
    opens[1:] = ended[starts[1:]] != ended[starts[:-1]]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    size = ends - starts
    raw = folded[_WORD[folded]]
    at = np.concatenate(([0], np.cumsum(size)))
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
    return words.cast(pa.large_string()), opens, first


def _shards(depth: int, shard_words: int):
    kind = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("bwt", pa.binary()), ("vocabulary", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Shard] = {}
        base, made = TaskContext.get().partitionId() << 32, 0

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pylist([open_.pop(lang).row(base + made, lang, depth)], schema=kind)

        for batch in batches:
            for a, b, data, offsets in K.text_chunks(batch.column(1)):
                langs = batch.column(0).slice(a, b - a).dictionary_encode()
                code = langs.indices.to_numpy(zero_copy_only=False)
                words, opens, first = _words(data, offsets)
                of = np.repeat(code, np.diff(first))
                for k in np.unique(of).tolist():
                    lang = langs.dictionary[k].as_py()
                    at = np.flatnonzero(of == k)
                    shard = open_.setdefault(lang, _Shard())
                    shard.add(words.take(pa.array(at)), opens[at])
                    if shard.size >= shard_words:
                        yield closed(lang)
                while sum(s.size for s in open_.values()) > max(HELD_WORDS, shard_words):
                    yield closed(max(open_, key=lambda x: open_[x].size))
        for lang in sorted(open_):
            yield closed(lang)

    return run


@dataclass
class _Loaded:
    """An index row as it reaches a task."""

    index: FmIndex
    vocabulary: bytes
    codes: list[np.ndarray]
    seeds: list[np.uint64]

    @staticmethod
    def of(lang: str, bwt: bytes, vocabulary: bytes) -> _Loaded:
        data = np.frombuffer(vocabulary, np.uint8)
        blank = np.flatnonzero(data == 0x20)
        starts, ends = np.concatenate(([0], blank + 1)), np.append(blank, len(data))
        raw = np.frombuffer(lang.encode("utf-8") + b"|", np.uint8)
        both = (np.uint8(0), _OTHER)
        codes = [K.span_hashes(data ^ x, starts, ends) for x in both]
        seeds = [K.span_hashes(raw ^ x, np.array([0]), np.array([len(raw)]))[0] for x in both]
        return _Loaded(FmIndex(np.frombuffer(bwt, np.int32), len(starts)), vocabulary, codes, seeds)

    def keys(self, lo: np.ndarray, length: int, which: int) -> np.ndarray:
        """Hashes of the phrases of ``length`` words at ``lo``, built from the last word to the first."""
        out = np.full(len(lo), self.seeds[which], np.uint64)
        for ids in reversed(self.index.spelled(lo, length)):
            out = self.longer(out, ids, which)
        return out

    def longer(self, keys: np.ndarray, ids: np.ndarray, which: int) -> np.ndarray:
        return K.mix(keys * _STEP + self.codes[which][ids - 1])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


def _loaded(table: pa.Table) -> tuple[_Loaded, int, str]:
    (r,) = table.select(["shard", "lang", "bwt", "vocabulary"]).to_pylist()
    return _Loaded.of(r["lang"], r["bwt"], r["vocabulary"]), r["shard"], r["lang"]


COUNTS = "part int, shard long, keys binary, keys2 binary, sizes binary"
INTERVALS = "key long, key2 long, shard long, lo int, size int"
PACKED = "shard long, length int, packed binary"
TALLY = "part int, places binary, sizes binary"
_KINDS = {
    COUNTS: pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("keys2", pa.binary()), ("sizes", pa.binary())]),
    INTERVALS: pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("shard", pa.int64()), ("lo", pa.int32()), ("size", pa.int32())]),
    PACKED: pa.schema([("shard", pa.int64()), ("length", pa.int32()), ("packed", pa.binary())]),
    TALLY: pa.schema([("part", pa.int32()), ("places", pa.binary()), ("sizes", pa.binary())]),
}


def _planes(values: np.ndarray) -> bytes:
    """Small numbers byte plane by byte plane, so that the planes of zeros compress to nothing."""
    return values.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _tally(key: np.ndarray, size: np.ndarray, bits: int, least: int) -> pa.Table:
    """Counts up to ``least`` by place, the low ``bits`` of the key: one row per range, with the steps between its places."""
    place = key & ((1 << bits) - 1)
    order = np.argsort(place, kind="stable")
    place, size = place[order], size[order]
    begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    place, size = place[begin], np.minimum(np.add.reduceat(size, begin), least) if len(begin) else size
    width = (1 << bits) // RANGES
    cut = np.searchsorted(place, np.arange(RANGES + 1) * width)
    held = np.flatnonzero(np.diff(cut))
    parts = [(slice(cut[p], cut[p + 1]), p * width) for p in held]
    places = [_planes(np.diff(place[a], prepend=start)) for a, start in parts]
    return pa.table([held.astype(np.int32), places, [_planes(size[a]) for a, _ in parts]], schema=_KINDS[TALLY])


def _reached(bits: int, least: int):
    """A bitmap of the places of each range whose tallies reach ``least``; a task holds its own ranges only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, places, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(part, np.zeros((1 << bits) // RANGES, np.int32))
                at = np.cumsum(_from_planes(places))
                held[at] = np.minimum(held[at] + _from_planes(sizes), least)
        marks = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(marks, pa.binary())], ["part", "marks"])

    return run


def _marked(marks: Broadcast, bits: int, key: np.ndarray) -> np.ndarray:
    """Which keys lie at a marked place of the bitmap of 2 ** ``bits`` places."""
    at = key & ((1 << bits) - 1)
    return (np.frombuffer(marks.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _turn(key: np.ndarray) -> np.ndarray:
    """Bits of the key that turn shard numbers over, so that the smallest is another shard for another key."""
    return (key & 1023) << 32 | (key >> 10) & 63


def _pack(shard: int, length: int, lo: np.ndarray, size: np.ndarray) -> pa.Table:
    """A shard's intervals in one row, in rising order: all steps between starts, then all sizes."""
    order = np.argsort(lo, kind="stable")
    packed = _planes(np.diff(lo[order], prepend=0)) + _planes(size[order])
    return pa.table([[shard], [length], [packed]], schema=_KINDS[PACKED])


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(packed) // 2
    return np.cumsum(_from_planes(packed[:half]), dtype=np.int64), _from_planes(packed[half:]).astype(np.int64)


def _packer(length: int):
    def run(table: pa.Table) -> pa.Table:
        return _pack(table["shard"][0].as_py(), length, _column(table, "lo"), _column(table, "size"))

    return run


def _bundles(shard: int, key: np.ndarray, key2: np.ndarray, size: np.ndarray) -> pa.Table:
    """A shard's counts, one row per range of keys."""
    part = (key & (RANGES - 1)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(RANGES + 1))
    held = np.flatnonzero(np.diff(cut))
    ranges = [order[cut[p] : cut[p + 1]] for p in held]
    columns = ([key[a].tobytes() for a in ranges], [key2[a].tobytes() for a in ranges], [_planes(size[a]) for a in ranges])
    return pa.table([held.astype(np.int32), np.full(len(held), shard), *columns], schema=_KINDS[COUNTS])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, key2, size, told): counts over the shards of a range, in parts once too many keys are held; told is the least turned shard."""
    held: list[tuple[np.ndarray, ...]] = []
    many = 0

    def merged() -> tuple[np.ndarray, ...]:
        key, key2, size, told = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((key2, key))
        key, key2, size, told = key[order], key2[order], size[order], told[order]
        begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (key2[1:] != key2[:-1]))))
        return key[begin], key2[begin], np.add.reduceat(size, begin), np.minimum.reduceat(told, begin)

    for batch in batches:
        for _, shard, keys, keys2, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = np.frombuffer(keys, np.int64)
            held.append((key, np.frombuffer(keys2, np.int64), _from_planes(sizes).astype(np.int64), shard ^ _turn(key)))
            many += len(key)
            if many >= HELD_KEYS:
                held = [merged()]
                many = len(held[0][0])
                if 2 * many >= HELD_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "key2", "size", "told"])
                    held, many = [], 0
    if many:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["key", "key2", "size", "told"])


def _extensions(length: int, kind: str, marks: Broadcast | None = None, bits: int = 0, least: int = 0):
    """Extensions of one shard's phrases of ``length`` words, as COUNTS, INTERVALS or PACKED: all of them,
    or those at a marked place of a bitmap of 2 ** ``bits`` places. As TALLY, their counts up to ``least`` by place."""

    def run(index: pa.Table, before: pa.Table | None = None) -> pa.Table:
        if not index.num_rows or (length and not before.num_rows):
            return _KINDS[kind].empty_table()
        own, shard, _ = _loaded(index)
        lo, count = _unpack(before["packed"][0].as_py()) if length else (np.zeros(1, np.int64),) * 2
        owner, word, start, size = extended(own.index, length, lo, count)
        key = own.longer(own.keys(lo, length, 0)[owner], word, 0).view(np.int64)
        if kind == TALLY:
            return _tally(key, size, bits, least)
        if marks is not None:
            hit = np.flatnonzero(_marked(marks, bits, key))
            owner, word, start, size, key = (x[hit] for x in (owner, word, start, size, key))
        if kind == PACKED:
            return _pack(shard, length + 1, start, size)
        key2 = own.longer(own.keys(lo, length, 1)[owner], word, 1).view(np.int64)
        if kind == COUNTS:
            return _bundles(shard, key, key2, size)
        return pa.table([key, key2, np.full(len(key), shard), start.astype(np.int32), size.astype(np.int32)], schema=_KINDS[kind])

    return (lambda index, before: run(index, before)) if length else (lambda index: run(index))


def _phrases(index: pa.Table, rows: pa.Table) -> pa.Table:
    """The phrases that one shard spells out, with their counts: ``rows`` are its packed intervals and the keys it is to spell."""
    kind = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())])
    wanted = rows.filter(pc.is_valid(rows["key"]))
    if not index.num_rows or not wanted.num_rows:
        return kind.empty_table()
    own, _, lang = _loaded(index)
    vocabulary = pa.array(own.vocabulary.split(b" "), pa.binary()).cast(pa.string())
    packed = rows.filter(pc.is_valid(rows["packed"]))
    intervals = dict(zip(packed["length"].to_pylist(), packed["packed"].to_pylist(), strict=True))
    asked = wanted.select(["length", "key", "key2", "a"]).to_pandas()
    out = []
    for k, some in asked.groupby("length"):
        lo, _ = _unpack(intervals[k])
        held = pd.DataFrame({"key": own.keys(lo, k, 0).view(np.int64), "key2": own.keys(lo, k, 1).view(np.int64), "lo": lo})
        found = some.merge(held, on=["key", "key2"])
        parts = [vocabulary.take(pa.array(ids - 1)) for ids in own.index.spelled(found["lo"].to_numpy(), k)]
        text = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        out.append(pa.table([pa.array([lang] * len(text), pa.string()), np.full(len(text), k, np.int32), text, found["a"].to_numpy()], schema=kind))
    return pa.concat_tables(out)


# --- the operator --------------------------------------------------------------

def shard_index(docs: DataFrame, depth: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, lang, n_words, bwt, vocabulary): the indexes of all texts, stored in a table bucketed by shard."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").alias("text")).filter("text IS NOT NULL")
    made = rows.mapInArrow(_shards(depth, shard_words), "shard long, lang string, n_words long, bwt binary, vocabulary binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"phrase_index_{uuid.uuid4().hex}"
    made.repartition(parts, "shard").write.bucketBy(parts, "shard").option("path", shared_dir(spark, "phrase-index")).saveAsTable(name)
    return spark.table(name)


def _map_of(keys: DataFrame) -> Broadcast | None:
    """A bitmap of the low ``MAP_BITS`` bits of the keys, sent to the tasks; None for too many keys.

    The driver receives 2 ** MAP_BITS / 8 bytes at most, in parts of 32,768 bits.
    """
    if 8 * keys.count() > 1 << MAP_BITS:
        return None
    place = F.pmod("key", F.lit(1 << MAP_BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    whole = bytearray(max(1, (1 << MAP_BITS) // 8))
    for r in parts.collect():
        whole[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
    return keys.sparkSession.sparkContext.broadcast(bytes(whole))


def _tally_bits(words: int) -> int:
    """Places of the tally, as a power of two: about one for every two to four words."""
    return min(MOST_BITS, max(FEWEST_BITS, words.bit_length() - 2))


def _likely(tallies: DataFrame, bits: int, least: int) -> Broadcast:
    """The bitmap of the places that reach ``least``; the driver receives 2 ** bits / 8 bytes at most."""
    spark = tallies.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = (1 << bits) // RANGES // 8
    whole = bytearray(1 << bits - 3)
    for r in tallies.repartition(parts, "part").mapInArrow(_reached(bits, least), "part int, marks binary").collect():
        whole[r["part"] * width : (r["part"] + 1) * width] = r["marks"]
    return spark.sparkContext.broadcast(bytes(whole))


def frequent_phrases(index: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, length, phrase, a): every phrase of up to ``longest`` words with at least ``least`` occurrences."""
    rows = index.select("shard", "lang", "bwt", "vocabulary").groupBy("shard")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = _tally_bits(index.agg(F.sum("n_words")).first()[0] or 0)

    def extensions(length: int, before: DataFrame | None, kind: str, marks: Broadcast | None = None, places: int = bits) -> DataFrame:
        step = _extensions(length, kind, marks, places, least)
        return rows.applyInArrow(step, kind) if before is None else rows.cogroup(before.groupBy("shard")).applyInArrow(step, kind)

    spelling, found = None, None
    for length in range(longest):
        likely = _likely(extensions(length, found, TALLY), bits, least)
        bundles = extensions(length, found, COUNTS, likely).repartition(parts, "part")
        sums = bundles.mapInArrow(_summed, "key long, key2 long, size long, told long")
        counted = sums.groupBy("key", "key2").agg(F.sum("size").alias("a"), F.min("told").alias("told"))
        turn = F.shiftleft(F.col("key").bitwiseAND(1023), 32).bitwiseOR(F.shiftright("key", 10).bitwiseAND(63))
        counted = counted.select("key", "key2", "a", F.col("told").bitwiseXOR(turn).alias("shard"))
        heavy = stored(counted.filter(F.col("a") >= least), "phrase-keys")
        passed = _map_of(heavy.select("key"))
        if passed is not None:
            left = extensions(length, found, PACKED, passed, MAP_BITS)
        else:
            left = extensions(length, found, INTERVALS, likely).join(heavy, ["key", "key2"], "left_semi").groupBy("shard").applyInArrow(
                _packer(length + 1), PACKED)
        found = stored(left, "phrase-intervals")
        rows_of = found.unionByName(heavy.withColumn("length", F.lit(length + 1)), allowMissingColumns=True)
        spelling = rows_of if spelling is None else spelling.unionByName(rows_of)
    spelled = rows.cogroup(spelling.groupBy("shard")).applyInArrow(_phrases, "lang string, length int, phrase string, a long")
    return stored(spelled, "phrases")


def _exact(x) -> F.Column:
    return F.col(x).cast("decimal(19,0)")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, left_most, right_most): each language's best phrases of 2 to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring
    cut, ``n`` the language's words; left_most and right_most are the counts of
    the most frequent phrase one word longer to the left and to the right, NULL
    below ``least``. A phrase that only occurs inside a longer one (of up to ``longest`` words) is
    left out. NULL texts have no words, a NULL language is ``und``; repeated
    rows count each; NULL and repeated ids do not matter, and other columns are
    ignored. Languages without words, and empty tables, give no rows.
    """
    index = shard_index(docs, longest, shard_words)
    words = index.groupBy("lang").agg(F.sum("n_words").alias("n"))
    found = frequent_phrases(index, longest, least)
    candidates = found.filter("length >= 2").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select(
        "lang", "phrase", "length", "a", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"), "w"
    ).select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
             F.array_join(F.slice("w", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("rest"))
    part = found.select("lang", "phrase", "a")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.join(words, "lang").withColumns({"up": _exact("a") * _exact("n"), "down": _exact("l") * _exact("r")})
    # At most 1000 * n / r, so the quotient fits a long although its parts pass 64 bits.
    cuts = cuts.withColumn("score", F.expr("CAST(1000 AS DECIMAL(4,0)) * up div down"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    longer = candidates.filter("length >= 3")
    inner = longer.select("lang", F.array_join(F.slice("w", F.lit(2), F.col("length") - 1), " ").alias("phrase"), F.col("a").alias("left"), F.lit(None).cast("long").alias("right")).unionByName(
        longer.select("lang", F.array_join(F.slice("w", F.lit(1), F.col("length") - 1), " ").alias("phrase"), F.lit(None).cast("long").alias("left"), F.col("a").alias("right")))
    most = inner.groupBy("lang", "phrase").agg(F.max("left").alias("left_most"), F.max("right").alias("right_most"))
    open_ = best.join(most, ["lang", "phrase"], "left").select("lang", "phrase", "b.*", "left_most", "right_most").filter(
        "a > coalesce(greatest(left_most, right_most), 0)")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    slot = F.pmod(F.xxhash64("phrase"), F.lit(SLOTS))
    ahead = open_.withColumn("_slot", slot).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_slot").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_most", "right_most")
