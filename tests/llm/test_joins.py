import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from weirwork.llm import ego_join, graph, ngram_join


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = roots(range(len(rows)), links)
    least = defaultdict(lambda: 10**18)
    for i, (d, _) in enumerate(rows):
        least[of[i]] = min(least[of[i]], d)
    return sorted((d, len(sets[i]), least[of[i]]) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=12, size=14):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, size)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [w[k], "new"]])
                w = w or ["x"]
            if rnd.random() < 0.3:
                w += passage
            rows.append((len(rows) * 7 % 1009, rnd.choice([" ", "  ", "\n"]).join(w).title() if rnd.random() < 0.3 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "percent", "few", "seed"), [(4, 85, 10**9, 1), (4, 85, -(10**9), 2), (5, 80, -(10**9), 3)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent, few, seed):
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", few)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, ngram_join.jaccard_components(docs, n, percent).collect()))
    assert got == brute(rows, n, percent)


def test_a_dense_group_is_not_compared_in_pairs(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.jaccard_components(docs).collect()} == {0}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b"), (7, "word " * 30000), (8, "WORD " * 30000), (6, "a b"), (9, "É é"), (10, "é é")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, n_shingles int")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))
    assert got == brute(rows, 4, 85)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    no_id = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert sorted(ngram_join.jaccard_components(no_id).collect(), key=str)[0]["component_id"] == 3


def test_one_per_component(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, text, "b"), (1, text + " z", "a"), (3, "other text here", "c"), (3, "other text here", "c"), (4, None, "d"), (None, text, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["extra"]) for r in kept.collect()) == [(0, "e"), (1, "a"), (3, "c"), (4, "d")]


def test_graph(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    edges = spark.createDataFrame(links, "a long, b long")
    want = roots({x for a, b in links if a != b for x in (a, b)}, [x for x in links if x[0] != x[1]])
    groups, wanted = defaultdict(set), defaultdict(set)
    for r in graph.components(edges).collect():
        groups[r["root"]].add(r["node"])
    for n, r in want.items():
        wanted[r].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    assert graph.components(edges.limit(0)).count() == 0


def vectors(seed, n=700, width=24):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(40, width))
    x = centre[r.integers(0, 40, n)] + r.normal(size=(n, width)) * r.choice([0.02, 0.2, 1.0], (n, 1))
    x[::50] = x[0]
    return x.astype(np.float32)


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCK", 64)
    monkeypatch.setattr(ego_join, "LEAF", 16)
    monkeypatch.setattr(ego_join, "FAN", 2)
    x = vectors(1)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    of = roots(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    rows = [(i + 10, v.tolist()) for i, v in enumerate(x)]
    found = ego_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()
    assert {r["vec_id"] - 10: (r["n_links"], r["component_id"] - 10, r["kept"]) for r in found} == {i: (int(near[i].sum()), of[i], of[i] == i) for i in range(len(x))}


def test_doubles_stay_doubles(spark):
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0]), (2, at(0.95 + 1e-9)), (3, at(0.95 - 1e-9)), (4, [0.0, -1e300]), (5, [0.0, -2e300])]
    found = ego_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (1, 4), 5: (1, 4)}


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, [3.0, 0.0]), (11, [1e-30, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, links string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ego_join.near_duplicates(table).collect()), key=str)
    linked = [(7, 4, 7, True), (7, 4, 7, True), (8, 4, 7, False), (None, 4, 7, False), (11, 4, 7, False)]
    assert got == sorted([(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)] + linked, key=str)
    assert ego_join.near_duplicates(table.limit(0)).count() == 0


def test_classes_travel_as_gaps():
    """Of a class only 64 bits go with its n-grams, as steps between ascending numbers, which pack into less than ten bytes a class did."""
    sets = np.sort(np.random.default_rng(5).integers(0, 1 << 64, 3000, np.uint64))
    packed = ngram_join._pack(ngram_join._gaps(sets))
    assert (np.cumsum(ngram_join._unpack(packed)[0], dtype=np.uint64) == sets).all()
    assert len(packed) < 7.5 * len(sets)
    assert not len(ngram_join._gaps(sets[:0]))
