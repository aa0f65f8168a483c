"""Language identification with a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; the
largest response of each filter feeds a softmax over the languages. The
network is trained in numpy on a bounded sample of labelled texts and applied
to all windows of every whole text in batches; a text's probabilities are the
mean over its windows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyframe.llm import textkit as K

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: languages (the most frequent), texts of each, and characters of a text.
MOST_LANGUAGES, TEXTS_EACH, CHARS_EACH = 200, 600, 3000
WINDOWS_EACH = 6
STEPS, BATCH, RATE = 500, 128, 0.02
#: Windows whose symbols are in memory together when texts are judged.
AT_ONCE = 2048
NO_LANGUAGE = "und"

_fold = K.FOLD.astype(np.int64)
#: Bytes as symbols: 0 padding, a-z, one each for digits, white space and other ASCII, then each byte from 128.
SYMBOL = np.where(
    (_fold >= 97) & (_fold <= 122), _fold - 96,
    np.where(_fold >= 128, _fold - 98, np.where((_fold >= 48) & (_fold <= 57), 27, np.where(K.SPACED, 29, 28))),
).astype(np.int64)
SYMBOLS = 160


def window_places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and text end of the texts' consecutive windows, and each text's first window; none for empty texts."""
    count = -(-np.diff(offsets) // WINDOW)
    first = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(count)), count)
    return offsets[text] + (np.arange(first[-1]) - first[text]) * WINDOW, offsets[text + 1], first


def windows_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Symbols of the windows at these places; those that reach past their text are padded."""
    at = start[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    return np.where(inside, SYMBOL[data[np.where(inside, at, 0)]], 0)


@dataclass
class ByteNetwork:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width: (width, SYMBOLS, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def trained(cls, windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> ByteNetwork:
        """Fit by Adam on mini-batches that hold every language alike; the seed fixes the result."""
        rng = np.random.default_rng(seed)
        n = len(languages)
        net = cls(
            languages, {w: rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS},
            np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, n)).astype(np.float32), np.zeros(n, np.float32),
        )
        held = [np.flatnonzero(labels == k) for k in range(n)]
        values = [*net.filters.values(), net.bias, net.out, net.out_bias]
        mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for step in range(1, STEPS + 1):
            lang = rng.integers(0, n, BATCH)
            pick = np.array([held[k][rng.integers(len(held[k]))] for k in lang])
            grads = net._gradients(windows[pick], lang)
            rate = RATE * (1 - step / (STEPS + 1)) + 1e-4
            for v, g, m, s in zip(values, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
        return net

    def _gradients(self, x: np.ndarray, lang: np.ndarray) -> list[np.ndarray]:
        rows = np.arange(len(x))
        tops, places = [], []
        for w, f in self.filters.items():
            z = sum(f[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            places.append(z.argmax(axis=1))
            tops.append(z.max(axis=1))
        raw = np.concatenate(tops, axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        p = _softmax(hidden @ self.out + self.out_bias)
        p[rows, lang] -= 1
        p /= len(x)
        back = (p @ self.out.T) * (raw > 0)
        grads = []
        for k, (w, f) in enumerate(self.filters.items()):
            g = np.zeros_like(f)
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, places[k] + j, axis=1), np.arange(FILTERS)), d)
            grads.append(g)
        return [*grads, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def prepared(self) -> list[tuple[np.ndarray, ...]]:
        """Responses to pairs of symbols, so that a filter of width 4 takes two lookups for a place."""
        out = []
        for w, f in self.filters.items():
            pairs = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
            out.append((w, pairs, f[w - 1] if w % 2 else None))
        return out

    def probabilities(self, x: np.ndarray, tables: list[tuple[np.ndarray, ...]], batch: int = 256) -> np.ndarray:
        """Softmax over the languages for each window."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), batch):
            s = x[a : a + batch]
            pair = s[:, :-1] * SYMBOLS + s[:, 1:]
            tops = []
            for w, pairs, single in tables:
                n = WINDOW - w + 1
                z = pairs[0].take(pair[:, :n], axis=0)
                for k in range(1, len(pairs)):
                    z += pairs[k].take(pair[:, 2 * k : 2 * k + n], axis=0)
                if single is not None:
                    z += single.take(s[:, w - 1 : w - 1 + n], axis=0)
                tops.append(z.max(axis=1))
            hidden = np.maximum(np.concatenate(tops, axis=1) + self.bias, 0)
            out[a : a + batch] = _softmax(hidden @ self.out + self.out_bias)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(labelled: DataFrame) -> ByteNetwork | None:
    """A network from (doc_id, text, lang); None without labelled text.

    The sample holds the beginnings of each language's texts that come first in
    the order of a hash of their id; its size is bounded by the constants above.
    """
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    often = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in often.collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "text")
    # Of a frequent language only about four times the wanted texts are ranked, by a hash of their id.
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, 4 * TEXTS_EACH / sizes[k])))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    rows = usable.filter(F.col("lang").isin(languages) & drawn).select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.substring("text", 1, CHARS_EACH).alias("text"))
    sample = sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= TEXTS_EACH).drop("n").collect())
    windows, labels = [], []
    for lang, text in ((lang, t) for _, lang, t in sample if has_letter(t)):
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        last = max(1, len(raw) - WINDOW + 1)
        for a in range(0, last, max(WINDOW, last // WINDOWS_EACH)):
            part = raw[a : a + WINDOW]
            windows.append(windows_of(part, np.array([0]), np.array([len(part)]))[0])
            labels.append(languages.index(lang))
    if not windows:
        return None
    seen = sorted(set(labels))
    return ByteNetwork.trained(np.array(windows), np.array([seen.index(k) for k in labels]), [languages[k] for k in seen])


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def with_languages(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced); only ``text`` is looked at.

    A NULL text or one without a letter is ``und`` with score 0, and so is all
    without a network.
    """
    rows = docs.drop("lang_pred", "score")
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at_text = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.prepared() if network else []
        ascii_letter = (SYMBOL > 0) & (SYMBOL < 27)
        for batch in batches:
            for a, b, data, off in K.text_chunks(batch.column(at_text)):
                lang, score = np.full(b - a, NO_LANGUAGE, object), np.zeros(b - a)
                if network and len(data):
                    full = np.flatnonzero(np.diff(off) > 0)
                    letters = np.zeros(b - a, bool)
                    letters[full] = np.add.reduceat(ascii_letter[data], off[:-1][full]) > 0
                    for d in full[~letters[full]].tolist():
                        part = data[off[d] : off[d + 1]]
                        letters[d] = bool((part >= 128).any()) and has_letter(part.tobytes().decode("utf-8"))
                    start, end, first = window_places(off)
                    text, windows = np.repeat(np.arange(b - a), np.diff(first)), np.diff(first)
                    sums = np.zeros((b - a, len(network.languages)))
                    for w in range(0, len(start), AT_ONCE):  # a very long text's windows are added up as they come
                        part = slice(w, w + AT_ONCE)
                        np.add.at(sums, text[part], network.probabilities(windows_of(data, start[part], end[part]), tables))
                    mean = sums[full] / windows[full][:, None]
                    best = mean.argmax(axis=1)
                    lang[full], score[full] = np.array(network.languages, object)[best], mean.max(axis=1)
                    lang[~letters], score[~letters] = NO_LANGUAGE, 0.0
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], [*rows_columns, "lang_pred", "score"])

    rows_columns = rows.columns
    return rows.mapInArrow(run, schema)


def identified(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the labelled rows outside the held-out fold, applied to every row.

    Repeated rows get equal results; NULL labels teach nothing; extra columns
    are ignored.
    """
    fold = fold_of(F.col("doc_id"), folds) == held
    network = train(docs.filter(~fold).select("doc_id", "text", "lang"))
    out = with_languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), network)
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
