"""Vectorised word splitting and hashing over Arrow string columns.

Everything works on the bytes of many texts at once with numpy, in chunks of
about a megabyte, so that the cost per word is a few array operations and the
memory is bounded by the chunk (or by one text, if that is longer). Words of
the contracts are separated by ASCII bytes only, so byte masks equal the
character patterns on UTF-8 text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_bytes = np.arange(256)
#: A-Z folded to a-z, every other byte as it is.
FOLD = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Bytes of a word ``[^\x20\x09-\x0D]+``.
SPACED = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
#: Bytes of a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are folded.
ALNUM = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SHINGLE = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, up to ``n``."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, np.uint64(base), np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def byte_codes(rows: np.ndarray, width: int) -> np.ndarray:
    """Each byte of equally wide rows with its place's weight; sums over places are ``span_hashes`` before mixing."""
    return _BYTE_CODE[rows] * power_tables(width)[0][:width]


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    release()


_libc = ctypes.CDLL(None)


def release() -> None:
    """Freed memory back to the system: Python workers serve many tasks and would keep what the largest one took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def word_spans(folded: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each text's first word (one more entry than texts)."""
    if not len(folded):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = letters[folded]
    cut = offsets[1:-1]
    cut = cut[cut < len(folded)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from differences of one running polynomial."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        stop = int(ends[j - 1])
        up, down = power_tables(stop - base)
        code = _BYTE_CODE[folded[base:stop]]
        code *= up[: stop - base]
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(code, out=total[1:])
        a = starts[i:j] - base
        out[i:j] = (total[ends[i:j] - base] - total[a]) * down[a]
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in text order and each text's first shingle.

    A text of fewer than ``k`` words, but not none, has its whole sequence as one.
    """
    count = np.diff(first)
    total = words.copy()
    n = len(words)
    for step in range(1, k):
        total[: n - step] = total[: n - step] * _SHINGLE[step % 4] + words[step:]
        total[: n - step] ^= total[: n - step] >> np.uint64(29)
    end = np.repeat(first[1:], count)
    valid = np.arange(n) + k <= end
    for d in np.flatnonzero((count > 0) & (count < k)):
        a, b = int(first[d]), int(first[d + 1])
        code = (b - a) * 0x632BE59BD9B4E019 & _MASK
        for w in words[a:b].tolist():
            code = (code * 0xD1342543DE82EF95 + w) & _MASK
        valid[a] = True
        total[a] = code
    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    return mix(total[valid]), np.concatenate(([0], np.cumsum(sizes)))


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and each text's first."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = first[:-1]
    keep[starts[starts < len(values)]] = True
    ahead = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], ahead[first]
