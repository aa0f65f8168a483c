"""Line dedup, decontamination, mixing and the pipeline against plain versions; registered queries against their SQL."""

import glob
import hashlib
import itertools
import os
import random
import time

import duckdb
import numpy as np
import pytest
from brute import contamination, line_dedup, mixed, similar, words
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import decontamination as D
from tallyframe.llm import line_dedup as L
from tallyframe.llm import mixing, stages
from tallyframe.llm import queries as registered
from tallyframe.llm.common import table

SMALL = "/root/testdata/sf0.001"


# --- lines --------------------------------------------------------------

def line_docs(seed, n=40):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["a", "bb", "ccc", "dd"]) + str(rng.randint(0, 9)) for _ in range(rng.choice([1, 3, 6, 12, 25]))) for _ in range(14)]
    own = [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.choice([2, 10, 30]))) for _ in range(80)]
    rows = [(k, "\n".join(rng.choice(pool if rng.random() < 0.6 else [*own, "", "  "]) for _ in range(rng.randint(1, 14)))) for k in range(n)]
    return rows + [(k + n, t) for k, t in rows[:5]] + [rows[3], (900, None), (901, ""), (902, "\n\n"), (None, rows[0][1]), (903, "w " * 60 + "\n" + "  w " * 60), (904, rows[7][1] + "\n" + "x\n" * 5000)]


@pytest.mark.parametrize("seed", range(4))
def test_lines_equal_the_definition(make_docs, seed):
    rows = line_docs(seed)
    want = sorted(((i, t, u) for (i, t), u in zip(rows, line_dedup(rows), strict=True)), key=str)
    out = L.dedup_lines(make_docs(rows)).collect()
    gone = {(r["doc_id"], r["n_lines"], r["text"]) for r in out}
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(((i, u) for i, _, u in want), key=str)
    assert (900, 0, None) in gone and (901, 1, "") in gone and (902, 3, "\n\n") in gone


@pytest.mark.parametrize("many", [0, 10**9])
def test_repeated_lines_inside_texts(make_docs, monkeypatch, many):
    monkeypatch.setattr(L, "MANY", many)
    rng = random.Random(9)
    rows = [(k, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 9]))) for _ in range(rng.randint(5, 60)))) for k in range(12)]
    rows += [(50, "x y\n" * 70), (51, "p\nq r\n" * 40), (52, "x y\n" * 30 + "z\n" + "x y\n" * 30)]
    want = sorted(((i, u) for (i, _), u in zip(rows, line_dedup(rows), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in L.dedup_lines(make_docs(rows)).collect()), key=str) == want


def test_ends_of_many_matches():
    rng = random.Random(4)
    for _ in range(40):
        keys, source = ([bytes([rng.randint(0, 1)]) for _ in range(rng.randint(1, 50))] for _ in range(2))
        spots = [(a, b) for a in range(len(keys)) for b in range(len(source)) if keys[a] == source[b]]
        if spots:
            lo, hi = L._many_extended(keys, source, *map(np.array, zip(*spots, strict=True)))
            assert list(zip(lo.tolist(), hi.tolist(), strict=True)) == [L.extended(keys, source, a, b) for a, b in spots]


def test_repeats_cost_no_more_than_their_lines():
    n = 100_000
    started = time.process_time()
    gone = L.matched([b"x"] * n, [b"x"] * n, [1] * n, list(range(1, n)), [0] * (n - 1), 20)
    assert time.process_time() - started < 5 and not gone[0] and gone[1:].all()


def test_runs_around_a_line_that_came_first_elsewhere_go(make_docs):
    lines = sorted((" ".join(f"w{k}x{j}" for j in range(8)) for k in range(40)), key=lambda x: hashlib.md5(x.encode()).digest())
    least, a, b, c, d, e, f, *other = lines  # the least hash is selected in every window that holds it
    run = [a, b, least, c, d]
    rows = [(1, "\n".join([e, least, f])), (2, "\n".join([other[0], *run, other[1]])), (3, "\n".join([other[2], *run[:2], "", *run[2:], other[3]])),
            (4, "\n".join([b, least, c])), (5, "\n".join([f, least, c])), (None, "\n".join([least, c, d, other[4]])), (None, "\n".join([least, c, d, other[4]]))]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in L.dedup_lines(make_docs(rows)).collect()}
    assert {k: got[k] for k in (1, 2, 5)} == {k: (t, 0) for k, t in rows if k in (1, 2, 5)}
    assert got[3] == ("\n".join([other[2], "", other[3]]), 5) and got[4] == ("", 3) and got[None] == (other[4], 3)


@pytest.mark.parametrize("many", [0, 10**9])
@pytest.mark.parametrize("seed", range(2))
def test_exactly_the_lines_of_earlier_runs_go(make_docs, monkeypatch, seed, many):
    monkeypatch.setattr(L, "MANY", many)
    rng = random.Random(seed)
    pool = [" ".join(f"p{k}" for _ in range(rng.choice([2, 5, 9, 21]))) for k in range(9)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(2, 12)))) for k in range(40)]
    seen, want = set(), []
    for k, text in rows:
        own, gone = text.split("\n"), set()
        for a, b in itertools.combinations(range(len(own) + 1), 2):  # every run, not the shortest only
            if len(" ".join(own[a:b]).split()) >= 20:
                gone |= set(range(a, b)) if tuple(own[a:b]) in seen else set()
                seen.add(tuple(own[a:b]))
        want.append((k, "\n".join(x for n, x in enumerate(own) if n not in gone), len(own), len(gone)))
    assert sorted(tuple(r) for r in L.dedup_lines(make_docs(rows)).select("doc_id", "text", "n_lines", "n_removed").collect()) == want


def test_no_lines(make_docs):
    assert L.dedup_lines(make_docs([])).count() == 0


def test_a_repeated_run_shares_a_fingerprint():
    rng = random.Random(1)
    for _ in range(300):
        run = [(bytes([rng.randint(0, 255) for _ in range(8)]), rng.choice([1, 4, 9, 30])) for _ in range(rng.randint(1, 9))]
        if sum(w for _, w in run) < 20:
            continue
        picks = []
        for _ in range(2):
            ahead, after = ([(bytes([rng.randint(0, 255) for _ in range(8)]), rng.randint(1, 9)) for _ in range(rng.randint(0, 6))] for _ in range(2))
            doc = ahead + run + after
            picks.append({doc[k][0] for k in L.winnow([h for h, _ in doc], [w for _, w in doc], 20)} & {h for h, _ in run})
        assert picks[0] & picks[1]


# --- benchmark ----------------------------------------------------------

@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination_equals_the_definition(spark, make_docs, talk, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rng = random.Random(3)
    items = [(k, " ".join(talk(rng.choice([1, 2, 5, 13, 14, 40]), k))) for k in range(12)] + [(50, None), (51, ""), (52, "?!"), (None, "the of"), (3, None), (4, "Straße x1")]
    rows = []
    for k in range(60):
        w = talk(rng.choice([3, 20, 200]), 100 + k)
        v = (items[rng.randrange(12)][1]).split()
        a = rng.randrange(len(v))
        w[rng.randrange(len(w)) : 0] = v[a : a + rng.choice([5, 13, 40])]
        rows.append((k, " ".join(w).upper().replace(" ", "-", 3) if k % 3 else " ".join(w)))
    rows += [(100, None), (101, ""), (102, "--"), (103, items[3][1] + " " + items[3][1]), (None, items[4][1]), (0, "STRAßE x1"), (104, "a " * 50000 + items[5][1])]
    got = sorted((tuple(r)[:6] for r in D.contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    want = []
    for i, t in rows:
        n, hit, names = contamination(t, [x for x in items if x[0] is not None]) if i != 104 else (50000 + len(words(items[5][1])), *contamination(items[5][1], [x for x in items if x[0] is not None])[1:])
        want.append((i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=str)


def test_contamination_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    (r,) = D.contamination(make_docs([(1, "a b")]), none).collect()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (2, 0, False)
    assert D.contamination(make_docs([]), none).count() == 0


# --- mixing -------------------------------------------------------------

def test_mixing_equals_the_definition(make_docs):
    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([0, 1, 5, 50, 900]), "en", rng.choice(["a", "b", "b", "b", "é", "𝄞", "z", None])) for k in range(120)]
    rows += [(200, None, "en", "a"), (201, "", "en", "only"), (202, "x y", "en", "tiny"), (None, "p q r", "en", "a"), (5, "again and again", "en", "b")]
    got = sorted(((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mixed_documents(make_docs(rows)).collect()), key=str)
    plain = mixed([(i, t, s) for i, t, _, s in rows], lambda d: "" if d[0] is None else d[0])
    assert got == sorted(((r[0], *p) for r, p in zip(rows, plain, strict=True)), key=str)
    assert all(t <= 3 * n for _, n, _, t in got)
    assert mixing.mixed_documents(make_docs([])).count() == 0


def test_flow_is_cheapest_for_overlapping_sources():
    rng = random.Random(6)
    for _ in range(60):
        patterns = {f"p{k}": (rng.randint(1, 3), rng.sample(range(3), rng.randint(1, 3))) for k in range(rng.randint(1, 3))}
        quotas = {s: rng.randint(0, 5) for s in range(3)}
        got = mixing.routed(patterns, quotas)

        def feasible(amounts, patterns=patterns, quotas=quotas):
            names = list(patterns)
            for some in itertools.chain.from_iterable(itertools.combinations(names, n) for n in range(1, len(names) + 1)):
                reach = {s for p in some for s in patterns[p][1]}
                if sum(amounts[p] for p in some) > sum(quotas[s] for s in reach):
                    return False
            return True

        def cost(amounts, patterns=patterns):
            return sum(max(0, amounts[p] - k * patterns[p][0]) for p in patterns for k in (1, 2))

        ways = [dict(zip(patterns, x, strict=True)) for x in itertools.product(*[range(3 * w + 1) for w, _ in patterns.values()])]
        ways = [w for w in ways if feasible(w)]
        most = max(sum(w.values()) for w in ways)
        assert sum(got.values()) == most and cost(got) == min(cost(w) for w in ways if sum(w.values()) == most) and feasible(got)


def test_overlapping_sources_share_documents(spark):
    rows = [(k, "w " * 10, ["a"]) for k in range(6)] + [(10 + k, "w " * 10, ["a", "b"]) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    docs, sources = mixing.mix(df, F.col("members"), weights=(1, 2))
    aim = {r["source"]: r["target"] for r in sources.collect()}
    assert aim == {"a": 30.0, "b": 60.0}
    taken = {r["doc_id"]: r["taken"] for r in docs.collect()}
    assert sum(taken.values()) == 90 and sum(taken[k] for k in range(6)) == 30 and sum(taken[10 + k] for k in range(3)) == 60


# --- pipeline and registered queries ------------------------------------

def plain_pipeline(rows, items):
    """Stages 2 to 5 on [(id, text, source)]; the language stage keeps all texts with a letter here."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    left = line_dedup([(i, t) for i, t, _ in rows])
    rows = [(i, u, s) for (i, t, s), u in zip(rows, left, strict=True) if u == t or words(u)]
    kept, done = [], set()
    groups = similar([(i, t) for i, t, _ in rows])
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        root = groups[k][1] if groups[k][0] else ("alone", k)
        if root not in done:
            done.add(root)
            kept.append(rows[k])
    clean = []
    for r in kept:
        n, hit, _ = contamination(r[1], items)
        if not (hit and 20 * hit >= n):
            clean.append(r)
    return clean


def test_pipeline_equals_the_plain_one(spark, tmp_path):
    docs = table(spark, SMALL, "documents").limit(110)
    text = "this row repeats its id and text, and holds enough words for a fingerprint of its own so that it is told apart"
    more = spark.createDataFrame(
        [(5000, None, "en", "src1", None), (5001, "", "en", None, 0), (5002, "12 !!", "en", "src1", 5), (5003, text, "en", "src1", len(text)), (5003, text, "en", "src1", len(text)),
         (None, text + " indeed", "en", None, 9)], docs.schema)
    docs.unionByName(more).withColumn("score", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SMALL, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, str(tmp_path), "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    clean = plain_pipeline(rows, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = {(i, t): i for i, t, _ in clean}
    by = {}
    for r in got:
        assert (r["doc_id"], r["text"]) in key
        by.setdefault(r["source"], []).append(r)
    sizes = {}
    for _, t, s in clean:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    plain = mixed(clean, lambda d: 0)
    target = {s: p[1] for (_, _, s), p in zip(clean, plain, strict=True)}
    for s, some in by.items():
        assert all(r["target"] == target[s] and 0 < r["taken"] <= 3 * r["size"] for r in some)
        assert sum(r["taken"] for r in some) == min(int(target[s] + 0.5), 3 * sizes[s])


def test_stages_keep_the_columns_of_documents(spark, make_docs):
    docs = make_docs([(1, "alpha beta gamma", "en"), (2, None, None), (None, "delta epsilon", "en")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert list(out.columns)[:5] == list(stages.COLUMNS), name
        empty = stage(spark, docs.filter("false"), SMALL)
        assert empty.count() == 0, name


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(registered.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = registered.QUERIES[name](spark, SMALL)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall()))
