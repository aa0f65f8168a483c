"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

For every prefix of a piece the table stores the last token and the number of
tokens. Exactly one vocabulary entry that ends the prefix is compatible with
the last token before it (encoding their joined bytes gives these two tokens
again), so a prefix's count is one more than an earlier prefix's count, and a
budget is answered from the table without encoding anything again.

Pieces are what the vocabulary's splitting pattern gives; they are found for
many texts at once with array operations, and each distinct piece runs the
dynamic programme once per task. Strings the file lists as added tokens count
as one token each, wherever they stand, and split the text like its ends do.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textkit as K

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with Unicode's White_Space property.
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Distinct pieces a task remembers; the memory is emptied when it is full.
REMEMBERED = 1 << 20
#: Longer pieces run the dynamic programme alone.
LONG_PIECE = 48

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Letter, number, space or other for each code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter(
            (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
        )
        _classes[list(WHITE_SPACE)] = SPACE
    return _classes


def piece_starts(chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Marks the first character of each piece; ``text_starts`` are the indexes of non-empty texts' first characters.

    A piece is a contraction ('s 't 're 've 'm 'll 'd), a run of letters,
    numbers or other characters with at most one plain space before it, or
    white space, which leaves its last character out when text follows.
    """
    n = len(chars)
    kind = char_classes()[chars]
    opens = np.zeros(n + 1, bool)
    opens[text_starts] = True
    opens[n] = True
    run = opens.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    spaced = np.zeros(n, bool)  # a plain space of the same text stands before
    spaced[1:] = (chars[:-1] == 32) & ~opens[1:n]
    start = run[:n].copy()
    body = start & (kind != SPACE)
    start[body & spaced] = False
    # The last of several white-space characters before text starts a piece of its own.
    follows = np.zeros(n, bool)
    follows[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n]
    start |= follows
    # Contractions: an apostrophe that starts a piece, before letters.
    at = np.flatnonzero((chars == 39) & start)
    at = at[(at + 1 < n)]
    at = at[(kind[at + 1] == LETTER) & ~opens[at + 1]]
    if len(at):
        one = np.isin(chars[at + 1], [ord(c) for c in "stmd"])
        third = np.minimum(at + 2, n - 1)
        inside = (at + 2 < n) & ~opens[np.minimum(at + 2, n)]
        two = inside & np.isin(
            chars[at + 1].astype(np.int64) << 21 | chars[third],
            [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")],
        )
        hit = one | two
        start[at[hit] + 1] = False
        after = at[hit] + np.where(two[hit], 3, 2)
        start[after[after < n]] = True
    return start


class PrefixCounter:
    """Exact token counts of every prefix under the byte-level BPE of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.added = [t["content"] for t in whole.get("added_tokens") or []]
        self.added_pattern = self._added_pattern(whole.get("added_tokens") or [])
        # Bytes that print stand for themselves, the others for 256 and up, in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        odd = [b for b in range(256) if b not in set(plain)]
        self.byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
        self.vocab = {self._raw(t): i for t, i in model["vocab"].items() if all(c in self.byte_of for c in t)}
        self.rank = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((self._raw(a), self._raw(b)), k)
        reachable = {a + b for a, b in self.rank}
        self.vocab = {t: i for t, i in self.vocab.items() if len(t) == 1 or t in reachable}
        self.longest = max(map(len, self.vocab))
        self.tokens = sorted(self.vocab)
        self.number = {t: k for k, t in enumerate(self.tokens)}
        size = np.array([len(t) for t in self.tokens])
        ends = np.cumsum(size)
        codes = K.span_hashes(np.frombuffer(b"".join(self.tokens), np.uint8), ends - size, ends)
        self.token_at = np.argsort(codes)
        self.token_codes = codes[self.token_at]
        self.has_token = np.zeros(1 << 20, bool)
        self.has_token[(codes >> np.uint64(44)).astype(np.int64)] = True
        made = {a + b: (a, b) for a, b in self.rank}
        self.left_edges = {t: self._edges(t, made, 0) for t in self.tokens}
        self.right_edges = {t: self._edges(t, made, 1) for t in self.tokens}
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.known: dict[int, int] = {}

    def _edges(self, token: bytes, made: dict, side: int) -> list[tuple[bytes, int]]:
        """The parts standing at one edge of ``token`` while it is merged, each with the rank that absorbs it."""
        chain = [(token, 1 << 30)]
        while token in made:
            rank = self.rank[made[token]]
            token = made[token][side]
            chain.append((token, rank))
        return chain[::-1]

    @staticmethod
    def _added_pattern(added: list[dict]) -> re.Pattern | None:
        """Matches the added tokens, the longest first, with the white space or word limits their flags ask for."""
        parts = []
        for t in sorted(added, key=lambda t: -len(t["content"])):
            text = re.escape(t["content"])
            if t.get("single_word"):
                text = rf"(?<!\w){text}(?!\w)"
            parts.append((r"\s*" if t.get("lstrip") else "") + text + (r"\s*" if t.get("rstrip") else ""))
        return re.compile("|".join(parts)) if parts else None

    def added_spans(self, text: str, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First characters of the added tokens in ``text`` and the characters after them, none across a text's first character."""
        spans: list[tuple[int, int]] = []
        if self.added_pattern and any(t in text for t in self.added):
            cuts = [*opens.tolist(), len(text)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                spans += [(a + m.start(), a + m.end()) for m in self.added_pattern.finditer(text[a:b])]
        found = np.array(spans, np.int64).reshape(len(spans), 2)
        return found[:, 0], found[:, 1]

    def _raw(self, token: str) -> bytes:
        return bytes(self.byte_of[c] for c in token)

    def merged(self, piece: bytes) -> list[bytes]:
        """Byte-pair merging by rank, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.rank
        while len(parts) > 1:
            best = min(
                ((rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether encoding left + right gives these two tokens.

        Both sides merge in rising rank, so it is enough to follow the two
        parts that face each other and see whether they would merge first.
        """
        a, b = self.right_edges[left], self.left_edges[right]
        i = j = 0
        while True:
            (x, gone_x), (y, gone_y) = a[i], b[j]
            across = self.rank.get((x, y))
            if across is not None and across < gone_x and across <= gone_y:
                return False
            if gone_x == gone_y == 1 << 30:
                return True
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def _fits(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays of token numbers, remembering each pair."""
        keys = last * len(self.tokens) + token
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(0, len(self.pair_keys) - 1))
        fresh = np.unique(keys[self.pair_keys[at] != keys] if len(self.pair_keys) else keys)
        if len(fresh):
            if len(self.pair_keys) > REMEMBERED:
                self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
                fresh = np.unique(keys)
            n, t = len(self.tokens), self.tokens
            ok = np.array([self.compatible(t[k // n], t[k % n]) for k in fresh.tolist()], bool)
            place = np.searchsorted(self.pair_keys, fresh)
            self.pair_keys = np.insert(self.pair_keys, place, fresh)
            self.pair_fits = np.insert(self.pair_fits, place, ok)
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_fits[at]

    def last_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of many short pieces: the dynamic programme runs on all of them together."""
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, size = starts[order], (ends - starts)[order]
        widest = int(size[0])
        cells = np.minimum(starts[:, None] + np.arange(widest), len(data) - 1)
        code = K.byte_codes(data[cells], widest)
        total = np.zeros((widest + 1, len(starts)), np.uint64)
        np.cumsum(code.T, axis=0, out=total[1:])
        _, down = K.power_tables(widest)
        last = np.zeros((widest + 1, len(starts)), np.int64)
        count = np.zeros((widest + 1, len(starts)), np.int32)
        for i in range(1, widest + 1):
            open_ = np.arange(int(np.searchsorted(-size, -i, "right")))
            for j in range(max(0, i - self.longest), i):
                h = K.mix((total[i, open_] - total[j, open_]) * down[j])
                top = (h >> np.uint64(44)).astype(np.int64)
                hit = np.flatnonzero(self.has_token[top])  # most substrings stop here
                h = h[hit]
                at = np.minimum(np.searchsorted(self.token_codes, h), len(self.token_codes) - 1)
                same = self.token_codes[at] == h
                hit, at = hit[same], at[same]
                if not len(hit):
                    continue
                token, rows = self.token_at[at], open_[hit]
                if j:
                    ok = self._fits(last[j, rows], token)
                    hit, token, rows = hit[ok], token[ok], rows[ok]
                last[i, rows] = token
                count[i, rows] = count[j, rows] + 1
                open_ = np.delete(open_, hit)
                if not len(open_):
                    break
        out = np.empty(len(starts), np.int64)
        out[order] = count[size, np.arange(len(starts))]
        return out

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ... piece."""
        last, count = [b""], [0]
        vocab, longest = self.vocab, self.longest
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - longest), i):
                token = piece[j:i]
                if token in vocab and (j == 0 or self.compatible(last[j], token)):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary does not cover every byte")
        return count

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the pieces, marks of those that only stand inside white space, and of added tokens."""
        text = data.tobytes().decode("utf-8")
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        opens = np.unique(np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0]))
        lo, hi = self.added_spans(text, opens)
        opens = np.unique(np.concatenate((opens, lo, hi[hi < len(chars)])))
        begins = piece_starts(chars, opens)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            begins[a + 1 : b] = False
        marked = np.flatnonzero(begins)
        starts = at[marked]
        blank = char_classes()[chars[marked]] == SPACE
        final = np.append(marked[1:], len(chars)) - 1
        blank &= char_classes()[chars[final]] == SPACE
        inner = np.zeros(len(marked), bool)
        inner[1:] = blank[1:] & blank[:-1] & ~np.isin(marked[1:], opens)
        return starts, np.append(starts[1:], len(data)), inner, np.isin(marked, lo)

    def _counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes, at, back = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        found = np.array([known.get(c, 0) for c in codes.tolist()], np.int64)
        fresh = np.flatnonzero(found == 0)
        if len(fresh):
            a, b = starts[at[fresh]], ends[at[fresh]]
            short = b - a <= LONG_PIECE
            got = np.empty(len(fresh), np.int64)
            if short.any():
                got[short] = self.last_counts(data, a[short], b[short])
            for k in np.flatnonzero(~short).tolist():
                got[k] = self.prefixes(data[a[k] : b[k]].tobytes())[-1]
            found[fresh] = got
            known.update(zip(codes[fresh].tolist(), got.tolist(), strict=True))
        return found[back]

    def table(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece ends, tokens up to each end within its text, each text's first piece, ends at which a text may be cut)."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(offsets), np.int64), none.astype(bool)
        starts, ends, inner, added = self._pieces(data, offsets)
        counts = np.ones(len(starts), np.int64)
        if not added.all():
            counts[~added] = self._counts(data, starts[~added], ends[~added])
        total = np.cumsum(counts)
        first = np.searchsorted(starts, offsets)
        base = np.concatenate(([0], total))[first[:-1]]
        return ends, total - np.repeat(base, np.diff(first)), first, ~inner

    def prefix_count(self, text: str) -> list[int]:
        """Token counts at every piece end of ``text``, for cutting and budgets."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.table(raw, np.array([0, len(raw)]))[1].tolist()

    def cut(self, text: str, budget: int) -> str:
        """The longest prefix of whole characters with at most ``budget`` tokens, as far as pieces split alike.

        Inside a letter, number or other piece every prefix is a piece of its
        own and the table holds its count; white space and contractions are
        kept or dropped whole.
        """
        raw = text.encode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        ends, counts, _, safe = self.table(data, np.array([0, len(raw)]))
        k = bisect_right(counts.tolist(), budget)
        while k and not safe[k - 1]:
            k -= 1
        done, spent = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
        if k < len(ends):
            piece = raw[done : ends[k]]
            if piece.strip() and not piece.startswith(b"'"):
                table = self.prefixes(piece)
                size = bisect_right(table, budget - spent) - 1
                while size > 0 and done + size < len(raw) and (raw[done + size] & 0xC0) == 0x80:
                    size -= 1
                done += size if size > 1 or piece[:1] != b" " else 0
        return raw[:done].decode("utf-8")


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per file and process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, cut_bytes) of every row.

    ``tokenizer`` names a file of ``public_tokenizers`` or is a path all
    executors see. cut_bytes is the longest prefix ending with a piece that
    keeps within ``limit`` tokens. A NULL text counts as empty, with 0 bytes and
    tokens; NULL and repeated ids are kept row by row; other columns are ignored.
    Added tokens are recognised inside texts, as the library does by default.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = counter(tokenizer if "/" in tokenizer else str(public_tokenizers.path(tokenizer)))
        for batch in batches:
            for a, b, data, off in K.text_chunks(batch.column(1)):
                ends, counts, first, safe = c.table(data, off)
                full = first[1:] > first[:-1]
                tokens = np.zeros(b - a, np.int64)
                tokens[full] = counts[first[1:][full] - 1]
                cut = np.diff(off)
                for d in np.flatnonzero(tokens > limit).tolist():
                    lo = int(first[d])
                    k = int(np.searchsorted(counts[lo : first[d + 1]], limit, "right"))
                    while k and not safe[lo + k - 1]:
                        k -= 1
                    cut[d] = ends[lo + k - 1] - off[d] if k else 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit), pa.array(cut)],
                    ["id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")
    return out.withColumnRenamed("id", id_col)
