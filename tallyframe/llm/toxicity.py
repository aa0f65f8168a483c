"""Toxic documents by multiple-instance learning over sentences.

Only documents are labelled, but a toxic one needs just one toxic sentence. A
sentence's probability is the logistic of the sum of its words' weights; a
document's is their noisy-or with a leak: one minus the leak's complement times
the complements of its sentences. The leak stands for labels that no sentence
explains, so that long clean documents do not add up to a toxic one. Weights,
offset and leak are fitted together to the document labels by gradient
descent in numpy; the sentences' own probabilities then say where it offends.

Only words that tell the classes apart in the sample get a weight, as wrong
labels would otherwise be learnt by heart from rare words; a sentence without
such a word counts for nothing.

A sentence ends at ``.``, ``!``, ``?`` or a line end and after ``SENTENCE``
words; words are hashed to ``BUCKETS`` weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import textkit as K
from tallyframe.llm.language_id import fold_of

FOLDS = 5
SENTENCE = 40
BUCKETS = 1 << 18
#: Bounds of the training sample: labelled documents of each class, and characters of their texts together.
DOCS_EACH, CHARS_EACH = 2000, 12_000_000
#: A word gets a weight if its share of toxic documents in the sample departs from the sample's by so many standard deviations.
TELLING = 5.0
#: Strength of the pull of weights to 0.
PULL = 1e-4
STEPS, RATE = 250, 0.05

_END = np.zeros(256, bool)
_END[[*b".!?\n"]] = True


@dataclass
class SentenceModel:
    """Weights of hashed words, a sentence's offset and the leak (both as log odds)."""

    weights: np.ndarray
    offset: float = -6.0
    leak: float = -30.0

    def sentence_odds(self, sentence: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Log odds of the sentences; minus infinity without a word that has a weight."""
        w = self.weights[bucket]
        told = np.bincount(sentence, w != 0, minlength=n) > 0
        return np.where(told, np.bincount(sentence, w, minlength=n) + self.offset, -np.inf)


def _soft(z: np.ndarray | float) -> np.ndarray:
    """-log(1 - logistic(z))."""
    return np.logaddexp(0.0, z)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each word, bucket of each word, start and end byte of each sentence, each text's first sentence)."""
    folded = K.FOLD[data]
    starts, ends, first = K.word_spans(folded, offsets, K.ALNUM)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(len(offsets), np.int64)
    stops = np.cumsum(_END[folded])
    opens = np.ones(len(starts), bool)
    opens[1:] = stops[starts[1:]] != stops[starts[:-1]]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    place = np.arange(len(starts))
    since = place - np.maximum.accumulate(np.where(opens, place, 0))
    opens |= since % SENTENCE == 0
    sentence = np.cumsum(opens) - 1
    begin = np.flatnonzero(opens)
    final = np.append(begin[1:], len(starts)) - 1
    bucket = (K.span_hashes(folded, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    return sentence, bucket, starts[begin], ends[final], np.searchsorted(begin, first)


def fit(texts: list[str], toxic: list[int], weight: dict[int, float]) -> SentenceModel:
    """The model of the sampled documents; each class counts with its weight. One class only gives no word a weight."""
    y = np.array(toxic, np.int64)
    share = np.array([weight[c] for c in toxic], float)
    model = SentenceModel(np.zeros(BUCKETS))
    if not len(y):
        return model
    share /= share.sum()
    prior = min(max(float(share @ y), 1e-6), 1 - 1e-6)
    model.leak = float(np.log(prior / (1 - prior)))
    if len(np.unique(y)) < 2:
        return model
    column = pa.array(texts, pa.large_string())
    parts, docs_of, done = [], [], 0
    for a, b, data, offsets in K.text_chunks(column):
        sentence, bucket, _, _, first = sentences(data, offsets)
        parts.append((sentence + done, bucket))
        docs_of.append(np.repeat(np.arange(a, b), np.diff(first)))
        done += len(docs_of[-1])
    sentence, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc = np.concatenate(docs_of)
    pairs = np.unique(doc[sentence] * BUCKETS + bucket)
    held = np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    bad = np.bincount(pairs % BUCKETS, y[pairs // BUCKETS], minlength=BUCKETS)
    part = y.mean()
    keep = (np.abs(bad - held * part) >= TELLING * np.sqrt(np.maximum(held, 1) * part * (1 - part)))[bucket]
    used, column_of = np.unique(bucket[keep], return_inverse=True)
    told, row_of = np.unique(sentence[keep], return_inverse=True)
    owner = doc[told]
    theta = np.concatenate((np.zeros(len(used)), [model.offset, model.leak]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, offset, leak = theta[:-2], theta[-2], theta[-1]
        z = np.bincount(row_of, w[column_of], minlength=len(told)) + offset
        hidden = np.bincount(owner, _soft(z), minlength=len(y)) + _soft(leak)
        p = -np.expm1(-hidden)
        # d loss / d hidden of -log p for toxic documents and of hidden itself for the others
        slope = share * np.where(y == 1, -np.exp(-hidden) / np.maximum(p, 1e-12), 1.0)
        dz = slope[owner] / (1 + np.exp(-z))
        grad = np.concatenate((
            np.bincount(column_of, dz[row_of], minlength=len(used)) + PULL * w,
            [dz.sum(), float(slope.sum()) / (1 + np.exp(-leak))]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * 4 ** (1 - step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights[used] = theta[:-2]
    model.offset, model.leak = float(theta[-2]), float(theta[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> SentenceModel:
    """The model learnt from a bounded sample of labelled documents outside the held-out fold.

    Per class the ``DOCS_EACH`` ids with the smallest hashes, as far as their
    texts keep within ``CHARS_EACH`` characters. Repeated labels of an id count
    as the highest, repeated rows of an id as one document; NULL ids, labels
    and texts are not learnt from. Only these ids reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter(
        "id IS NOT NULL AND y IS NOT NULL").filter(fold_of(F.col("id"), FOLDS) != 0)
    known = known.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    size = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Ranked are only the ids that a hash picks, about twice as many as wanted of each class.
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, min(1.0, 2 * DOCS_EACH / max(1, size.get(1, 0)))).otherwise(min(1.0, 2 * DOCS_EACH / max(1, size.get(0, 0))))
    order = Window.partitionBy("y").orderBy(slot, "id")
    chosen = known.filter(slot < share * (1 << 30)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= DOCS_EACH)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).filter("text IS NOT NULL")
    # At most 2 * DOCS_EACH ids are broadcast.
    sampled = texts.join(F.broadcast(chosen), "id")
    lengths = sampled.groupBy("id").agg(F.max("y").alias("y"), F.max("place").alias("place"), F.min(F.length("text")).alias("chars")).collect()
    left, ids = {0: CHARS_EACH, 1: CHARS_EACH}, {}
    for r in sorted(lengths, key=lambda r: r["place"]):
        if r["chars"] <= left[r["y"]]:
            left[r["y"]] -= r["chars"]
            ids[r["id"]] = r["chars"]
    if not ids:
        return SentenceModel(np.zeros(BUCKETS))
    # The shortest text of each id: its length was counted above.
    found = sampled.filter(F.col("id").isin(list(ids))).groupBy("id").agg(
        F.max("y").alias("y"), F.min(F.struct(F.length("text"), "text")).alias("t")).select("id", "y", "t.text").collect()
    found = sorted(found, key=lambda r: r["id"])
    y = [r["y"] for r in found]
    return fit([r["text"] for r in found], y, {c: size.get(c, 1) / max(1, y.count(c)) for c in (0, 1)})


def scored(docs: DataFrame, model: SentenceModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, n_offending, offending) of every row's whole text.

    offending lists the sentences whose own probability reaches ``threshold``:
    first character (from 0), number of characters, probability. A NULL or
    empty text has no sentences and scores the leak. NULL ids are not held
    out; repeated rows are judged each; other columns are ignored.
    """
    model_ = SentenceModel(model.weights.astype(np.float32), model.offset, model.leak)
    edge = float(np.log(threshold / (1 - threshold)))
    place = pa.struct([("first_char", pa.int64()), ("n_chars", pa.int64()), ("score", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.text_chunks(batch.column(2)):
                sentence, bucket, start, end, first = sentences(data, offsets)
                z = model_.sentence_odds(sentence, bucket, len(start))
                soft = np.concatenate(([0.0], np.cumsum(_soft(z))))
                score = -np.expm1(-(soft[first[1:]] - soft[first[:-1]] + _soft(model_.leak)))
                bad = np.flatnonzero(z >= edge)
                upto = np.searchsorted(bad, first)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                text = np.searchsorted(first, bad, "right") - 1
                spots = pa.StructArray.from_arrays(
                    [pa.array(chars[start[bad]] - chars[offsets[text]]), pa.array(chars[end[bad]] - chars[start[bad]]), pa.array(1 / (1 + np.exp(-z[bad])))],
                    fields=list(place))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.clip(score, 0.0, 1.0)),
                     pa.array((score >= threshold).astype(np.int32)), pa.array(np.diff(first)), pa.array(np.diff(upto)),
                     pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), spots)],
                    ["doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "offending"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(
        judge, "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_offending long, "
        "offending array<struct<first_char long, n_chars long, score double>>")


def offending_sentences(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """(doc_id, first_char, score, sentence): every offending sentence of rows with different ids."""
    spots = scored(docs, model).filter("n_offending > 0").select("doc_id", F.explode("offending").alias("o"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    sentence = F.substring("_text", F.col("o.first_char").cast("int") + 1, F.col("o.n_chars").cast("int"))
    return spots.join(texts, "doc_id").select("doc_id", "o.first_char", "o.score", sentence.alias("sentence"))
