"""Clustering, phrases and toxicity against plain versions, with edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import centroid_clustering as C
from tallyframe.llm import collocations as P
from tallyframe.llm import queries as registered
from tallyframe.llm import toxicity as T
from tallyframe.llm.common import table

SMALL = "/root/testdata/sf0.001"


# --- clustering ---------------------------------------------------------

@pytest.mark.parametrize("spread", [1, 30, 100_000])
def test_search_finds_the_nearest(spread):
    rng = np.random.default_rng(spread)
    centroids = rng.integers(-spread, spread + 1, (25, 7)) + rng.integers(-3 * spread, 3 * spread, (25, 1))
    centroids[9] = centroids[4]
    x = np.concatenate((rng.integers(-2 * spread, 2 * spread + 1, (800, 7)), centroids))
    who, best, computed = C.SortedCentroids(centroids).nearest(x)
    d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert computed < d.size  # something was rejected unmeasured


def plain_clusters(rows, k, rounds, seed=2):
    """[(id, integer vector)] to (labels, distances, centroids)."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    now = [rows[i][1] for i in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now)) for _, v in rows]

    for _ in range(rounds):
        got = assign()
        for n in range(len(now)):
            own = [v for (_, v), (_, m) in zip(rows, got, strict=True) if m == n]
            if own:
                now[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign(), now


def test_clusters_equal_the_definition(spark):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(k % 5, 1) for _ in range(6)]) for k in range(150)]
    rows += [(3, rows[3][1]), (4, [0.0] * 6), (None, [1.0] * 6), (None, [1.0] * 6), (900, rows[9][1])]
    bad = [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 5 + [None]), (504, [float("nan")] + [1.0] * 5), (505, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4).withColumn("cluster", F.lit("x")).withColumn("id", F.lit(0)).withColumn("v", F.lit(0))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want, centroids = plain_clusters(whole, 12, 4)
    out, now = C.cluster(df, centroids=12, rounds=4, dimensions=6)
    assert now.tolist() == centroids
    inertia = collections.Counter()
    for d, c in want:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    plain = [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(whole, want, strict=True)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(plain, key=str)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    out, now = C.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), dimensions=2)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()) == [(1, 0, 0), (2, 0, 0)] and len(now) == 2
    assert C.cluster(spark.createDataFrame([], schema))[0].count() == 0
    with pytest.raises(Exception, match="64 bits"):
        C.cluster(spark.createDataFrame([(1, [1e30, 2.0])], schema), dimensions=2)[0].count()


# --- phrases ------------------------------------------------------------

def test_index_counts_every_phrase():
    rng = np.random.default_rng(3)
    text = np.concatenate(([0], rng.integers(0, 6, 4000), [0]))
    index = P.FmIndex.of(text, 5)
    want = collections.Counter(tuple(text[i : i + k].tolist()) for k in range(1, 6) for i in range(len(text) - k + 1) if 0 not in text[i : i + k])
    lo, count, got = np.zeros(1, np.int64), np.zeros(1, np.int64), {}
    for length in range(5):
        _, _, lo, count = P.extended(index, length, lo, count)
        got |= dict(zip(zip(*[x.tolist() for x in index.spelled(lo, length + 1)], strict=True), count.tolist(), strict=True))
    assert got == dict(want)


def plain_collocations(docs, longest, least, top):
    """[(text, lang)] to rows, from the counts of all phrases."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p for p, c in f.items() if c >= least and len(p) > 2}
    inside = {(p[0], *p[i : i + k]) for p in often for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if f[p] >= f[(p[0], *p[i : i + k])]}
    rows = []
    for p in often - inside:
        cuts = [(1000 * f[p] * n[p[0]] // (f[p[:j]] * f[(p[0], *p[j:])]), j) for j in range(2, len(p))]
        score, j = min(cuts)
        rows.append((p[0], " ".join(p[1:]), f[p], f[p[:j]], f[(p[0], *p[j:])], n[p[0]], score))
    out = []
    for lang in n:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], k + 1, *r[1:]) for k, r in enumerate(own)]
    return out


@pytest.mark.parametrize(("shard_words", "bits"), [(50, P.MAP_BITS), (1 << 19, P.MAP_BITS), (300, 0)])
def test_phrases_equal_the_definition(make_docs, monkeypatch, shard_words, bits):
    monkeypatch.setattr(P, "MAP_BITS", bits)  # 0 takes the way by a join
    rng = random.Random(11)
    words = ["of", "the", "The", "a", "é", "new", "york", "x-y", "𝄞", "Ä", "'s"]
    fixed = ["kick the bucket", "New York city hall", "of of of of of of"]
    rows = []
    for k in range(200):
        parts = [rng.choice(fixed) if rng.random() < 0.15 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "!", "; "]) for p in parts)
        rows.append((k, text, rng.choice(["en", "en", "fr", None, "und"])))
    rows += [(500, None, "en"), (501, "", "fr"), (502, " .,;: ", "de"), (502, rows[0][1], rows[0][2]), (None, "the cat " * 3000, "en"), (503, "  no break " * 4, "it")]
    got = P.collocations(make_docs(rows), least=4, top=30, shard_words=shard_words).collect()
    want = plain_collocations([(t, g) for _, t, g in rows], 5, 4, 30)
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)
    assert P.collocations(make_docs([])).count() == 0


def test_tallies_lose_no_phrase():
    rng = np.random.default_rng(3)
    bits, least = 12, 5
    shards = [rng.integers(-(1 << 62), 1 << 62, 400) for _ in range(30)]
    shards = [np.concatenate((k, [7, -9])) for k in shards]  # two keys that every shard holds
    sizes = [rng.integers(1, 3, len(k)) for k in shards]
    tables = [P._tally(k, n, bits, least) for k, n in zip(shards, sizes, strict=True)]
    assert P._tally(np.zeros(0, np.int64), np.zeros(0, np.int64), bits, least).num_rows == 0
    whole = np.zeros(1 << bits, int)
    for k, n in zip(shards, sizes, strict=True):
        np.add.at(whole, k & ((1 << bits) - 1), n)
    got = np.zeros(1 << bits, bool)
    width = (1 << bits) // P.RANGES
    for batch in P._reached(bits, least)(b for t in tables for b in t.to_batches()):
        for part, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[part * width : (part + 1) * width] = np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little")[:width]
    assert (got == (whole >= least)).all() and 0 < got.sum() < len(got)
    assert got[7] and got[-9 & ((1 << bits) - 1)]


@pytest.mark.parametrize("words", [0, 1, 1 << 20, 1 << 60])
def test_places_grow_with_the_words(words):
    assert P.FEWEST_BITS <= P._tally_bits(words) <= P.MOST_BITS


def test_most_frequent_extensions(make_docs):
    rows = [(1, "a b c. " * 6 + "b c d. " * 5 + "b c", "en")]
    out = {r["phrase"]: r for r in P.collocations(make_docs(rows), least=2).collect()}
    assert (out["b c"]["a"], out["b c"]["left_most"], out["b c"]["right_most"]) == (12, 6, 5)
    assert out["a b c"]["left_most"] is None and "a b" not in out


def test_scores_pass_64_bits(spark):
    big = 9 * 10**14
    row = spark.createDataFrame([(big, big * 3, 7, 11)], "a long, n long, l long, r long")
    up, down = P._exact("a") * P._exact("n"), P._exact("l") * P._exact("r") * 10**14
    got = row.select(up.alias("up"), down.cast("decimal(38,0)").alias("down")).select(F.expr("CAST(1000 AS DECIMAL(4,0)) * up div down")).first()[0]
    assert got == 1000 * big * big * 3 // (77 * 10**14)


# --- toxicity -----------------------------------------------------------

def toxic_docs(talk, n=900):
    rng = random.Random(2)
    rows, marks, told = [], [], {}
    for k in range(n):
        some = [" ".join(talk(rng.randint(3, 15), 1000 * k + j)) for j in range(rng.choice([1, 4, 30]))]
        toxic = k % 4 == 0
        if toxic:
            at = rng.randrange(len(some))
            some[at] += " Grobble " + rng.choice(["vexl", "mumpf"])
            told[k] = some[at]
        rows.append((k, ". ".join(some) + "."))
        if k % 10:
            marks.append((k, 1, int(toxic != (rng.random() < 0.03))))
    return rows, marks, told


def test_toxic_documents_and_their_sentences(spark, make_docs, talk):
    rows, marks, told = toxic_docs(talk)
    rows += [(5000, None), (5001, ""), (5002, "?!"), (5003, "xgrobble " * 30000), (5004, " ".join(talk(40000, 9)) + " grobble mumpf"), (None, "grobble vexl"), (7, rows[7][1])]
    marks += [(1, 0, 1), (None, 1, 1), (3, 1, None), (9999, 0, 1)]
    docs, labels = make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    out = T.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and (r["doc_id"] or 0) < 900 and r["doc_id"] is not None]
    assert len(held) > 120
    right = sum((r["doc_id"] in told) == (r["predicted"] == 1) for r in held)
    assert right >= 0.97 * len(held)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[5000]["predicted"] == by_id[5001]["predicted"] == by_id[5002]["predicted"] == by_id[5003]["predicted"] == 0
    assert by_id[5004]["predicted"] == by_id[None]["predicted"] == 1 and by_id[5004]["n_sentences"] == -(-40002 // T.SENTENCE)
    found = T.offending_sentences(docs.filter("doc_id < 900").dropDuplicates(["doc_id"]), model).collect()
    assert sum(r["sentence"] == told.get(r["doc_id"]) for r in found) >= 0.95 * len(told)
    assert sum(r["doc_id"] not in told for r in found) <= 0.03 * len(rows)


def test_no_labels_one_class_no_documents(spark, make_docs):
    docs, schema = make_docs([(1, "a b. c"), (2, None)]), "doc_id long, quality int, toxic int"
    for marks in ([], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)], [(77, 0, 1)]):
        model = T.train(docs, spark.createDataFrame(marks, schema))
        assert len(T.scored(docs, model).collect()) == 2
        assert T.scored(make_docs([]), model).count() == 0


def test_scores_are_the_noisy_or(make_docs):
    model = T.SentenceModel(np.zeros(T.BUCKETS), -3.0, -4.0)
    _, bucket, *_ = T.sentences(np.frombuffer(b"bad", np.uint8), np.array([0, 3]))
    model.weights[bucket] = 2.5
    texts = ["Bad. good. bad bad", "good", "é bad\nx"]
    odds = [[-0.5, 2.0], [], [-0.5]]
    got = {r["doc_id"]: r for r in T.scored(make_docs(list(enumerate(texts))), model).collect()}
    for k, some in enumerate(odds):
        left = np.prod([1 / (1 + np.exp(z)) for z in [*some, -4.0]])
        assert abs(got[k]["score"] - (1 - left)) < 1e-6
    (o,) = got[0]["offending"]
    assert (o["first_char"], o["n_chars"]) == (11, 7) and got[2]["n_offending"] == 0


def test_held_out_documents_of_the_given_tables(spark):
    out = registered.op13_toxicity(spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.85 * len(out)
