import collections
import math
import random

import pytest

from weirwork.operators import subtrees as D
from weirwork.operators import term_graph as G


def test_associations_and_ranks_equal_plain_ones(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("abcdefg", weights=[9, 5, 4, 3, 2, 2, 1], k=12)) for _ in range(30)] + ["x y x y", None, "lone"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    c = collections.Counter()
    for t in texts:
        w = (t or "").split()
        c.update(tuple(sorted(p)) for p in zip(w, w[1:], strict=False) if p[0] != p[1])
    total, of = sum(c.values()), collections.Counter()
    for (a, b), n in c.items():
        of[a] += n
        of[b] += n
    want = {p: math.log(n * 2 * total / (of[p[0]] * of[p[1]])) for p, n in c.items() if n >= 2}
    want = {p: x for p, x in want.items() if x > 0}
    graph = G.associations(docs).cache()
    got = {(r["source"], r["target"]): r["pmi"] for r in graph.collect()}
    assert got == pytest.approx(want)
    near = collections.defaultdict(dict)
    for (a, b), x in want.items():
        near[a][b] = near[b][a] = x
    seeds = [s for s in ("a", "x", "zz", "a") if s in near]
    start = {s: 1 / len(set(seeds)) for s in seeds}
    rank = dict(start)
    for _ in range(G.ROUNDS):
        new = collections.defaultdict(float, {s: 0.15 * p for s, p in start.items()})
        for t, p in rank.items():
            for u, x in near[t].items():
                new[u] += 0.85 * p * x / sum(near[t].values())
        rank = new
    found = {r["term"]: r["rank"] for r in G.page_rank(graph, ["a", "x", "zz", "a"]).collect()}
    assert found == pytest.approx(dict(rank))
    assert sum(found.values()) == pytest.approx(1)
    assert G.page_rank(graph, ["zz"]).count() == 0
    assert G.expand(graph, ["x"], 3) == ["x", "y"]


def test_a_round_shuffles_no_arcs(spark):
    arcs = spark.range(500).selectExpr("cast(id % 50 AS string) AS source", "cast(id AS string) AS target", "0.1D AS share").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source").persist()
    arcs.count()
    start = spark.createDataFrame([("1", 1.0)], "term string, start double")
    ranks = spark.range(50).selectExpr("cast(id AS string) AS term", "0.02D AS rank")
    plan = G._round(ranks.hint("merge"), arcs, start, 0.85)._jdf.queryExecution().executedPlan().toString()
    arcs.unpersist()
    below = [x for x in plan.split("InMemoryTableScan")[0].split("\n") if "hashpartitioning(source" in x]
    assert "InMemoryTableScan" in plan and not below


def test_trees_with_moves(spark):
    left = {"a/b/1": "p", "a/b/2": "q", "a/c/3": "r", "old/x/4": "s", "old/x/y/5": "t", "f": "u", "g": "v", "dup1": "w", "dup2": "w", "k/6": "m", "k/7": None}
    right = {"a/b/1": "p", "a/b/2": "q", "a/c/3": "changed", "new/z/4": "s", "new/z/y/5": "t", "h": "u", "g": "v", "dup3": "w", "i": "n", "k/6": "m", "k/7": None}
    frame = lambda d: spark.createDataFrame([*d.items(), (None, "p")], "path string, digest string").repartition(3)
    got = sorted(map(tuple, D.diff_subtrees(frame(left), frame(right)).collect()))
    assert got == sorted(
        [
            ("a/b", "dir", "same", None, 2), ("k", "dir", "same", None, 2), ("a/c/3", "file", "changed", None, 1), ("new/z", "dir", "moved", "old/x", 2), ("h", "file", "moved", "f", 1), ("g", "file", "same", None, 1),
            ("dup1", "file", "removed", None, 1), ("dup2", "file", "removed", None, 1), ("dup3", "file", "added", None, 1), ("i", "file", "added", None, 1),
        ]
    )
    assert D.diff_subtrees(frame({}), frame({})).count() == 0


def test_hunks_turn_one_text_into_the_other(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        left = [rnd.choice(["a", "b", "", f"line {k}"]) for k in range(rnd.randint(0, 25))]
        right = [x for x in left if rnd.random() > 0.2]
        for _ in range(rnd.randint(0, 4)):
            right.insert(rnd.randint(0, len(right)), rnd.choice(["a", "new"]))
        rows.append((i, "\n".join(left), "\n".join(right)))
    rows += [(100, None, "x\ny"), (101, "x", None), (102, "same", "same")]
    by = collections.defaultdict(list)
    for r in D.diff_lines(spark.createDataFrame(rows, "name long, left string, right string")).orderBy("name", "hunk").collect():
        by[r["name"]].append(r)
    for i, left, right in rows:
        lines = (left or "").split("\n") if left else []
        for h in reversed(by[i]):
            assert lines[h["left_start"] : h["left_start"] + len(h["removed"])] == h["removed"]
            lines[h["left_start"] : h["left_start"] + len(h["removed"])] = h["added"]
        assert "\n".join(lines) == (right or "")
    assert not by[102]
    assert list(D.hunks(list("abcXdef"), list("abcdeYf"))) == [(3, 4, 3, 3), (6, 6, 5, 6)]
    assert D.anchors(list("abcd"), list("cabd")) == [(0, 1), (1, 2), (3, 3)]


def test_prompts(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 4, "system", "be brief"), (2, 0, "user", "x"), (3, 0, "system", None), (None, 0, "system", "z")]
    found = D.extract_prompts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, "be kind\nbe brief"), (3, "")]
