"""Near copies: the join against all pairs, its tree, and its parts that only large groups reach."""

import numpy as np
import pytest
from brute import similar

from tallyframe.llm import jaccard_join as J
from tallyframe.llm import textkit as K
from tallyframe.llm.common import connected_components


def groups(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], str(r["component_id"])) for r in J.similar_groups(df)[0].collect())


def expected(rows):
    found = similar(rows)
    least = {}
    for k, (_, root) in found.items():
        i = rows[k][0]
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return sorted(
        (i is None, i or 0, found[k][0], str(least.get(found[k][1]) if found[k][0] else i)) for k, (i, _) in enumerate(rows))


def corpus(talk):
    rows, i = [], 0
    passage = talk(60, 999)
    for g in range(6):  # near copies with growing distance
        base = talk(80, g)
        for k in range(6):
            w = list(base)
            for p in range(0, 80, 40)[: k // 2]:
                w[p + k] = f"w{g}{k}"
            rows.append((i, " ".join(w)))
            i += 1
    for k in range(90):  # one passage in many otherwise different texts
        rows.append((i, " ".join(talk(40, 2000 + k) + passage)))
        i += 1
    rows += [(i + k, " ".join(talk(30, 77))) for k in range(5)]
    return rows


EDGES = [
    (900, None), (901, ""), (902, " \t\n"), (903, "A b C"), (904, "a  B\tc"), (905, "a b c d"), (906, "a b c d e"), (907, "one two three four five six " * 3000),
    (908, "one two three four five six " * 3000 + "seven"), (None, "a b c"), (None, "only here without id"), (903, "A b C"),
]


def test_join_equals_all_pairs(make_docs, talk):
    rows = corpus(talk) + EDGES
    assert groups(make_docs(rows)) == expected(rows)


def test_large_regions_are_cut(make_docs, talk, monkeypatch):
    monkeypatch.setattr(J, "REGION", 4)
    monkeypatch.setattr(J, "LEADERS", 1)
    rows = corpus(talk)
    assert groups(make_docs(rows)) == expected(rows)


def test_common_groups_are_regions_too(make_docs, talk, monkeypatch):
    monkeypatch.setattr(J, "COMMON", 2)
    rows = corpus(talk)
    assert groups(make_docs(rows)) == expected(rows)


def test_shared_hot_passage_emits_no_pairs_of_all_its_documents(make_docs, talk):
    rows = [(k, " ".join(talk(40, 100 + k) + talk(60, 999))) for k in range(120)]
    out, links = J.similar_groups(make_docs(rows))
    assert links.count() == 0 and {r["component_id"] for r in out.collect()} == set(range(120))


def test_empty_table(make_docs):
    assert groups(make_docs([])) == []


def test_tree_join_finds_every_pair_above_the_bound():
    rng = np.random.default_rng(3)
    for m in (3, 17, 150):
        counts = rng.poisson(3, (m, J.GROUPS)).astype(np.uint32)
        for k in range(0, m - 1, 3):
            counts[k + 1] = counts[k]
        sizes, comps = counts.sum(axis=1).astype(np.int64), np.arange(m) // 4
        tree = J.CountTree(counts, sizes, comps)
        got = {tuple(sorted(map(int, p))) for a, b in J.tree_join(tree, tree, 80) for p in zip(a, b, strict=True)}
        want = {
            (a, b) for a in range(m) for b in range(a + 1, m)
            if comps[a] != comps[b] and np.minimum(counts[a], counts[b]).sum() >= J.least_overlap(sizes[a], sizes[b])}
        assert got == want
        half = J.CountTree(counts[: m // 2], sizes[: m // 2], comps[: m // 2]), J.CountTree(counts[m // 2 :], sizes[m // 2 :], comps[m // 2 :])
        cross = {(int(a), int(b) + m // 2) for x, y in J.tree_join(*half, 80) for a, b in zip(x, y, strict=True)}
        assert cross == {(a, b) for a, b in want if a < m // 2 <= b}


def test_word_hashes_do_not_depend_on_the_place():
    import pyarrow as pa

    texts = ["the Cat sat", "cat", "", None, "x" * 3_000_000 + " cat"]
    hashes = []
    for _, _, data, off in K.text_chunks(pa.array(texts)):
        low = K.FOLD[data]
        starts, ends, first = K.word_spans(low, off, K.SPACED)
        h = K.span_hashes(low, starts, ends)
        hashes += [h[first[k] : first[k + 1]].tolist() for k in range(len(off) - 1)]
    assert hashes[0][1] == hashes[1][0] == hashes[4][1] and hashes[2] == hashes[3] == []


@pytest.mark.parametrize("edges, want", [
    ([], {}), ([(1, 1), (None, 2)], {}), ([(k, k + 1) for k in range(40)], {k: 0 for k in range(41)}),
    ([(0, k) for k in range(1, 50)] + [(90, 91)], {**{k: 0 for k in range(50)}, 90: 90, 91: 90}),
])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == want


def test_spread_labels_join_only_what_is_linked(spark):
    from tallyframe.llm.jaccard_join import spread_labels

    star = [(50, k) for k in range(40, 60) if k != 50]
    chain = [(k, k + 1) for k in range(100, 120)]
    got = {r["node"]: r["root"] for r in spread_labels(spark.createDataFrame(star + chain, "a long, b long")).collect()}
    assert {got[k] for k in range(40, 60)} == {40}
    assert [got[k] for k in range(100, 121)] == [max(100, k - 3) for k in range(100, 121)]
    assert spread_labels(spark.createDataFrame([], "a long, b long")).count() == 0
