"""Scoring texts with a class-based bigram model (Brown classes by exchange).

P(w | v) = P(class(w) | class(v)) P(w | class(w)), interpolated with P(w), for
known words; unknown words share the probability that word forms seen once
had (Good-Turing). Counts of words, classes and transitions are taken over all
training texts:

1. every word is counted;
2. words get classes by exchange: the ``CLUSTERED`` most frequent ones one at a
   time until none moves, which gives the others a start by their ending (last
   two bytes); then all of the ``CARRIED`` most frequent words in sweeps, each task
   moving its words by their whole contexts, until the likelihood settles; then
   every other word is placed by its own contexts, by the same gain;
3. class transitions are counted over all training tokens;
4. all texts are scored. Counts and classes of the carried words travel to the
   tasks; tokens of all other words are joined with their table, so the
   vocabulary may grow without bound. Words that no training text has take the
   class that words with their ending mostly have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import textkit as K
from tallyframe.llm.common import stored
from tallyframe.llm.language_id import fold_of

#: Words exchanged on the driver to start from, and the classes of all words; the last class stands for words without one.
CLUSTERED, CLASSES = 1024, 32
#: Sweeps end once one raises the likelihood by less than this share of what the first one did.
SETTLED = 0.02
#: A sweep that lowers the likelihood, as words moved past each other, is taken back, and words move in twice as many turns, up to these.
TURNS = 8
#: Words whose gains are computed at once.
BLOCK = 256
#: Words whose counts and classes are sent to every task: 17 bytes each.
CARRIED = 1 << 19
#: Counts from here on fall in one bin when the two limits are located.
TOP_COUNT = 1 << 16
#: Weight of the class model against the unigram, and of the prior of a transition.
MIX, PRIOR = 0.9, 10.0
#: Words gathered before a task hands on its counts.
GATHERED = 2 << 20


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, endings, first words) of chunks of texts."""
    for a, b, data, off in K.text_chunks(column):
        folded = K.FOLD[data]
        starts, ends, first = K.word_spans(folded, off, K.SPACED)
        ending = folded[ends - 1].astype(np.int64) * 256
        long = ends - starts > 1
        ending[long] += folded[ends[long] - 2]
        yield a, b, K.span_hashes(folded, starts, ends).view(np.int64), ending, first


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, ending): occurrences of every word, by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def given() -> pa.RecordBatch:
            words, endings = (np.concatenate(x) for x in zip(*held, strict=True))
            word, at, n = np.unique(words, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n), pa.array(endings[at])], ["word", "n", "ending"])

        for batch in batches:
            for _, _, words, endings, _ in _words(batch.column(0)):
                held.append((words, endings))
                size += len(words)
                if size >= GATHERED:
                    yield given()
                    held, size = [], 0
        if size:
            yield given()

    counted = texts.select("text").mapInArrow(count, "word long, n long, ending long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.max("ending").alias("ending"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word: words move one at a time to the class with the largest likelihood of ``bigrams``.

    The last word of the matrix stands for all words that are not clustered and
    keeps the last class to itself. Words start in turn by rank.
    """
    size = len(bigrams)
    label = np.arange(size) % max(1, classes - 1)
    label[-1] = classes - 1
    member = np.zeros((size, classes))
    member[np.arange(size), label] = 1
    table = bigrams.astype(float)
    right, left = table @ member, (member.T @ table).T  # word to class, class to word
    both = member.T @ right
    outs, ins = table.sum(axis=1), table.sum(axis=0)
    out_c, in_c = member.T @ outs, member.T @ ins

    moved = 1
    while moved:
        moved = 0
        for w in range(size - 1):
            c = label[w]
            r, l, own = right[w].copy(), left[w].copy(), table[w, w]
            r[c] -= own  # counts with the others only
            l[c] -= own
            both[c] -= r
            both[:, c] -= l
            both[c, c] -= own
            out_c[c] -= outs[w]
            in_c[c] -= ins[w]
            # Gain of joining each class: its row and its column change, the crossing cell by both.
            rows = (xlogx(both + r) - xlogx(both)).sum(axis=1)
            cols = (xlogx(both + l[:, None]) - xlogx(both)).sum(axis=0)
            k = np.arange(classes)
            cross = both[k, k]
            fix = xlogx(cross + r + l + own) - xlogx(cross + r) - xlogx(cross + l) + xlogx(cross)
            gain = rows + cols + fix - (xlogx(out_c + outs[w]) - xlogx(out_c)) - (xlogx(in_c + ins[w]) - xlogx(in_c))
            gain[-1] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = int(c)
            both[best] += r
            both[:, best] += l
            both[best, best] += own
            out_c[best] += outs[w]
            in_c[best] += ins[w]
            if best != c:
                moved += 1
                label[w] = best
                right[:, c] -= table[:, w]
                right[:, best] += table[:, w]
                left[:, c] -= table[w]
                left[:, best] += table[w]
    return label


def joining_gains(both: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Gain in likelihood of every word (row) joining each class, its own one (``label``) left first.

    ``both`` counts class pairs, ``right`` and ``left`` the classes after and
    before each word, ``own`` the word after itself, which they include.
    """
    rows, k = np.arange(len(right)), np.arange(len(both))
    x = np.repeat(both[None], len(right), axis=0)
    n_out, n_in = right.sum(axis=1)[:, None], left.sum(axis=1)[:, None]
    out, into = np.repeat(both.sum(axis=1)[None], len(right), axis=0), np.repeat(both.sum(axis=0)[None], len(right), axis=0)
    if label is not None:
        right, left = right.copy(), left.copy()
        right[rows, label] -= own
        left[rows, label] -= own
        x[rows, label] -= right
        x[rows, :, label] -= left
        x[rows, label, label] -= own
        out[rows, label] -= n_out[:, 0]
        into[rows, label] -= n_in[:, 0]
    now = xlogx(x)
    gain = (xlogx(x + right[:, None, :]) - now).sum(axis=2) + (xlogx(x + left[:, :, None]) - now).sum(axis=1)
    cross = x[:, k, k]
    gain += xlogx(cross + right + left + own[:, None]) - xlogx(cross + right) - xlogx(cross + left) + xlogx(cross)
    gain -= (xlogx(out + n_out) - xlogx(out)) + (xlogx(into + n_in) - xlogx(into))
    # Words that move at once would all take an empty class, each for being alone there.
    used = both.sum(axis=1) > 0
    if used[:-2].any():
        gain[:, ~used] = -np.inf
    return gain


@dataclass
class ClassModel:
    """What the tasks need: classes, log weights of class pairs, and counts of frequent words."""

    carried: np.ndarray  # hashes, sorted
    carried_counts: np.ndarray
    labels: np.ndarray  # their classes
    by_ending: np.ndarray  # class of words that no training text has, by ending
    classes: int
    pair_logs: np.ndarray | None = None
    total: int = 0
    distinct: int = 0
    ends: int = 0
    unseen: float = 1.0

    @property
    def end(self) -> int:
        """The class of the end of a text, also what a text begins after."""
        return self.classes

    @property
    def kinds(self) -> int:
        return self.classes + 1

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the carried words, and which words are carried."""
        if not len(self.carried):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.carried, words), len(self.carried) - 1)
        return at, self.carried[at] == words

    def classify(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = self.by_ending[endings]
        at, hit = self.found(words)
        out[hit] = self.labels[at[hit]]
        return out


def _beside(kind: np.ndarray, first: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands left and right of every word; ``edge`` at the ends of a text."""
    left, right = np.full(len(kind), edge), np.full(len(kind), edge)
    left[1:], right[:-1] = kind[:-1], kind[1:]
    some = first[1:] > first[:-1]
    left[first[:-1][some]] = edge
    right[first[1:][some] - 1] = edge
    return left, right


def _counted(texts: DataFrame, keys: list[str], found) -> DataFrame:
    """(keys, n): how often ``found`` gives each pair of keys for the texts' words, dealt by the first key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def given() -> pa.RecordBatch:
            one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
            n = np.diff(np.append(new, len(one)))
            return pa.RecordBatch.from_arrays([pa.array(one[new]), pa.array(two[new]), pa.array(n)], [*keys, "n"])

        for batch in batches:
            for _, _, words, _, first in _words(batch.column(0)):
                one, two = found(words, first)
                if len(one):
                    held.append((one, two))
                    size += len(one)
                if size >= GATHERED:
                    yield given()
                    held, size = [], 0
        if size:
            yield given()

    counted = texts.select("text").mapInArrow(count, f"{keys[0]} long, {keys[1]} long, n long")
    return counted.repartition(keys[0]).groupBy(*keys).agg(F.sum("n").alias("n"))


def _bounds(counts: DataFrame) -> tuple[int, int, int, int]:
    """(tokens, distinct, words seen once, least count of a carried word) of the words."""
    bins = counts.groupBy(F.least("n", F.lit(TOP_COUNT)).alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()
    kept, least = 0, TOP_COUNT + 1
    for r in sorted(bins, key=lambda r: -r["b"]):
        if kept + r["k"] > CARRIED:
            break
        kept, least = kept + r["k"], r["b"]
    once = sum(r["k"] for r in bins if r["b"] == 1)
    return sum(r["n"] for r in bins), sum(r["k"] for r in bins), once, least


def train(texts: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of a table of training texts, and the stored counts and classes of the words it does not carry."""
    counts = stored(word_counts(texts), "lm-counts")
    ends = texts.count()
    total, distinct, once, least = _bounds(counts)
    frequent = counts.filter(F.col("n") >= least).select("word", "n", "ending").toArrow()
    word, n, ending = (frequent.column(c).to_numpy() for c in ("word", "n", "ending"))
    order = np.argsort(word)
    word, n, ending = word[order], n[order], ending[order]
    model = ClassModel(word, n, np.zeros(len(word), np.int8), np.zeros(1 << 16, np.int64), CLASSES)
    top = np.sort(np.lexsort((word, -n))[:CLUSTERED])
    labels = np.arange(len(word)) % (CLASSES - 1)
    labels[top] = _clustered(texts, word[top], n[top])
    # Each ending takes the class its words have most often, weighted by their counts.
    start = _by_ending(ending[top], labels[top], n[top])
    rest = np.setdiff1d(np.arange(len(word)), top)
    rest = rest[start[ending[rest]] < CLASSES - 1]
    labels[rest] = start[ending[rest]]
    model.labels = labels.astype(np.int8)
    both = _swept(texts, model)
    model.by_ending = _by_ending(ending, model.labels, n)
    model.total, model.distinct, model.ends = total + ends, distinct + (ends > 0), ends
    rare = _others(texts, model, both)
    _transitions(texts, model, both, rare, once)
    return model, rare.select("word", "n", "kind")


def _by_ending(ending: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    votes = np.zeros((1 << 16, CLASSES))
    np.add.at(votes, (ending, label), n)
    return np.where(votes.any(axis=1), votes.argmax(axis=1), CLASSES - 1)


def _swept(texts: DataFrame, model: ClassModel) -> np.ndarray:
    """Exchange all carried words (``model.labels``); the counts of class pairs in the end.

    The words beside each word are counted and stored once, a word's in one
    row, so sweeps neither shuffle nor read the texts again. In a sweep all
    words of a turn move at once, by the class pairs before it, and it counts
    only if the likelihood of the classes after it is higher.
    """
    size, kinds = len(model.carried), model.kinds
    other, edge = size, size + 1

    def sides(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, hit = model.found(words)
        at = np.where(hit, at, other)
        left, right = _beside(at, first, edge)
        return np.concatenate((at[hit], at[hit])), np.concatenate((left[hit], ~right[hit]))

    cells = _counted(texts, ["word", "side"], sides)
    beside = stored(cells.groupBy("word").agg(F.collect_list(F.col("side").cast("int")).alias("sides"), F.collect_list("n").alias("ns")), "lm-beside")

    def read(batch: pa.RecordBatch, labels: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words, and row, word beside, its class, whether it stands right, and count of their cells."""
        kind = np.append(labels, (model.classes - 1, model.end)).astype(np.int64)
        lists = batch.column(1)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        side, n = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
        right = side < 0
        side = np.where(right, ~side, side)
        return batch.column(0).to_numpy(), row, side, kind[side], right, n

    def pairs(labels: np.ndarray) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(kinds * kinds)
            for batch in batches:
                word, row, side, kind, right, n = read(batch, labels)
                own = labels[word].astype(np.int64)[row]
                keep = right | (side >= other)  # pairs of two carried words are counted from the first
                cell = np.where(right, own * kinds + kind, kind * kinds + own)
                table += np.bincount(cell[keep], n[keep], len(table))
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], ["cell", "n"])

        found = beside.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(kinds * kinds)
        table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
        return table.reshape(kinds, kinds)

    def moved(labels: np.ndarray, both: np.ndarray, turn: int, turns: int) -> np.ndarray:
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, row, side, kind, right, n = read(batch, labels)
                rows = len(word)
                table = np.bincount((row * 2 + right) * kinds + kind, n, rows * 2 * kinds).reshape(rows, 2, kinds)
                same = right & (side == word[row])
                own = np.bincount(row[same], n[same], rows)
                label = labels[word].astype(np.int64)
                for a in range(0, rows, BLOCK):
                    b = slice(a, a + BLOCK)
                    gain = joining_gains(both, table[b, 1], table[b, 0], own[b], label[b])[:, : model.classes - 1]
                    best, at = gain.argmax(axis=1), np.arange(len(gain))
                    label[b] = np.where((gain[at, best] > gain[at, label[b]] + 1e-9) & (word[b] % turns == turn), best, label[b])
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(label)], ["word", "label"])

        found = beside.mapInArrow(move, "word long, label long").toArrow()
        out = labels.copy()
        out[found.column("word").to_numpy()] = found.column("label").to_numpy()
        return out

    def likelihood(both: np.ndarray) -> float:
        return float(xlogx(both).sum() - xlogx(both.sum(axis=0)).sum() - xlogx(both.sum(axis=1)).sum())

    both = pairs(model.labels)
    if not size:
        return both
    now, most, turns = likelihood(both), 0.0, 1
    while True:
        begun, turn = now, 0
        while turn < turns:
            labels = moved(model.labels, both, turn, turns)
            table = pairs(labels)
            risen = likelihood(table)
            if risen > now:
                model.labels, both, now = labels, table, risen
            elif turns < TURNS and (labels != model.labels).any():
                turns, turn = turns * 2, -1
            turn += 1
        if now - begun <= SETTLED * most:
            return both
        most = max(most, now - begun)


def _others(texts: DataFrame, model: ClassModel, both: np.ndarray) -> DataFrame:
    """(word, n, kind, pairs, ns) of all words that are not carried, each placed in a class by all its contexts."""
    kinds = model.kinds

    def sides(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, hit = model.found(words)
        kind = np.full(len(words), model.classes - 1)
        kind[hit] = model.labels[at[hit]]
        left, right = _beside(kind, first, model.end)
        return words[~hit], (left * kinds + right)[~hit]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = len(lists)
            row = np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
            pair, n = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            left = np.bincount(row * kinds + pair // kinds, n, rows * kinds).reshape(rows, kinds)
            right = np.bincount(row * kinds + pair % kinds, n, rows * kinds).reshape(rows, kinds)
            kind = [joining_gains(both, right[a : a + BLOCK], left[a : a + BLOCK], np.zeros(min(BLOCK, rows - a)))[:, : model.classes - 1].argmax(axis=1)
                    for a in range(0, rows, BLOCK)]
            total = np.bincount(row, n, rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total), pa.array(np.concatenate(kind).astype(np.int32)), lists, batch.column(2)], ["word", "n", "kind", "pairs", "ns"])

    cells = _counted(texts, ["word", "pair"], sides).groupBy("word").agg(
        F.collect_list(F.col("pair").cast("int")).alias("pairs"), F.collect_list("n").alias("ns"))
    return stored(cells.mapInArrow(place, "word long, n long, kind int, pairs array<int>, ns array<long>"), "lm-others")


def _clustered(texts: DataFrame, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of the words from the bigram counts of all texts; at most (words + 1) squared cells reach the driver."""
    size = len(words) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, own, _, first in _words(batch.column(0)):
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                k = np.where(words[at] == own, at, size - 1)
                inside = np.ones(len(k), bool)
                inside[first[:-1][first[:-1] < len(k)]] = False
                table += np.bincount((k[:-1] * size + k[1:])[inside[1:]], minlength=size * size)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["cell", "n"])

    if not len(words):
        return np.zeros(0, np.int64)
    cells = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    # The exchange starts by rank, so words go in by falling count.
    order = np.append(np.lexsort((words, -n)), size - 1)
    label = np.empty(size, np.int64)
    label[order] = exchange(table.reshape(size, size)[np.ix_(order, order)], CLASSES)
    return label[:-1]


def _transitions(texts: DataFrame, model: ClassModel, both: np.ndarray, rare: DataFrame, once: int) -> None:
    """Class pairs of all tokens: of carried words as the sweeps counted them, of the others by their classes."""
    kinds, none = model.kinds, model.classes - 1

    def neighbours(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, hit = model.found(words)
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(~hit[:-1] & ~hit[1:] & (rows[:-1] == rows[1:]))
        return words[at], words[at + 1]

    if not model.total:
        return
    table = both.copy()
    table[none] = table[:, none] = 0
    cells = rare.select("kind", F.inline(F.arrays_zip("pairs", "ns"))).groupBy("kind", "pairs").agg(F.sum("ns").alias("n")).collect()
    for r in cells:
        left, right = divmod(r["pairs"], kinds)
        table[left, r["kind"]] += r["n"] * (left != none)
        table[r["kind"], right] += r["n"] * (right != none)
    kind = rare.select("word", "kind")
    met = _counted(texts, ["word", "next"], neighbours).join(kind, "word").join(kind.toDF("next", "to"), "next")
    for r in met.groupBy("kind", "to").agg(F.sum("n").alias("n")).collect():
        table[r["kind"], r["to"]] += r["n"]
    table[model.end, model.end] += model.ends - table[model.end].sum()  # texts without words
    size = table.sum(axis=0)
    step = (table + PRIOR * size / model.total) / (table.sum(axis=1, keepdims=True) + PRIOR)
    model.unseen = (once + 1) / (model.total + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        known = MIX * np.where(size > 0, step / size, 0.0) + (1 - MIX) / model.total
    model.pair_logs = np.log10((1 - model.unseen) * known).reshape(-1)


def scored(docs: DataFrame, model: ClassModel, rare: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row; ``rare`` has the words that are not carried."""
    space = model.total + model.distinct + 1
    kinds = model.kinds
    if not model.total:  # nothing was learned: every token is the one unknown symbol
        model.pair_logs = np.zeros(kinds**2)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                 ("word", pa.int64()), ("place", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("guess", pa.int32())]
        schema = pa.schema(names)
        logs = model.pair_logs

        def filled(k: int, **given: np.ndarray | pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(k, t) for c, t in names], schema=schema)

        for batch in batches:
            ids, doc_ids = batch.column(0).to_numpy(), batch.column(1)
            for a, b, words, endings, first in _words(batch.column(2)):
                at, hit = model.found(words)
                kind = np.full(len(words), -1)
                kind[hit] = model.labels[at[hit]]
                left, right = _beside(kind, first, model.end)
                text = np.repeat(np.arange(b - a), np.diff(first))
                t, own = text[hit], model.carried_counts[at[hit]].astype(float)
                # A pair with a word that is not carried counts at that word.
                step = np.where(left[hit] < 0, 0.0, logs[np.maximum(left[hit], 0) * kinds + kind[hit]])
                sums = np.bincount(t, np.log10((own + 1) / space), b - a), np.bincount(t, step + np.log10(own), b - a)
                last = np.full(b - a, model.end)
                some = first[1:] > first[:-1]
                last[some] = kind[first[1:][some] - 1]
                end_step = np.where(last < 0, 0.0, logs[np.maximum(last, 0) * kinds + model.end])
                end_score = end_step + np.log10(model.ends) if model.ends else np.full(b - a, np.log10(model.unseen))
                yield filled(b - a, row=ids[a:b], doc_id=doc_ids.slice(a, b - a), n_tokens=np.diff(first) + 1, n_known=np.bincount(t, minlength=b - a) + (model.ends > 0),
                             base=sums[0] + np.log10((model.ends + 1) / space), score=sums[1] + end_score)
                rest = np.flatnonzero(~hit)
                if len(rest):
                    yield filled(len(rest), row=ids[a:b][text[rest]], word=words[rest], place=rest - first[:-1][text[rest]], left=left[rest], right=right[rest],
                                 guess=model.by_ending[endings[rest]])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = stored(rows.mapInArrow(
        score, "row long, doc_id long, n_tokens long, n_known long, base double, score double, word long, place long, left int, right int, guess int"), "lm-scores")
    whole = parts.filter("word IS NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    spark = docs.sparkSession
    weights = spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.pair_logs)], "pair int, weight double")
    rest = parts.filter("word IS NOT NULL").select("row", "word", "place", "left", "right", "guess").join(rare, "word", "left").select(
        "row", "place", "left", "right", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kind", "guess").alias("kind"))
    # A word left of which another one stands that is not carried follows that one's row.
    before = F.when(F.col("left") < 0, F.lag("kind").over(Window.partitionBy("row").orderBy("place"))).otherwise(F.col("left"))
    rest = rest.withColumn("into", before * kinds + F.col("kind")).withColumn("out", F.when(F.col("right") >= 0, F.col("kind") * kinds + F.col("right")))
    joined = rest.join(F.broadcast(weights.toDF("into", "in_weight")), "into", "left").join(F.broadcast(weights.toDF("out", "out_weight")), "out", "left")
    own = F.when(F.col("n") > 0, F.col("in_weight") + F.log10("n")).otherwise(float(np.log10(model.unseen)))
    joined = joined.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), (F.col("n") > 0).cast("long").alias("n_known"),
        F.log10((F.col("n") + 1) / F.lit(float(space))).alias("base"), (own + F.coalesce("out_weight", F.lit(0.0))).alias("score"))
    return whole.unionByName(joined).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row")


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)


def scored_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    Learns from the rows outside the held-out fold and scores all. A NULL text
    is empty: one end token. Without training rows every token is unknown and
    has probability 1 in both models. Repeated rows are scored each; other
    columns are ignored.
    """
    held_out = fold_of(F.col("doc_id"), folds) == held
    model, rare = train(docs.filter(~held_out).select(F.col("text").cast("string").alias("text")))
    return scored(docs, model, rare).select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
        perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))
