import json
import math
import random
import re

import pytest

from weirwork.operators import block_index as X
from weirwork.operators import search as S
from weirwork.streaming.snapshots import Snapshots

WORDS = ["cat", "dog", "bird", "fish", "the", "of", "Ω", "new", "york", "tree"]


def some_docs(n, seed, start=0):
    rnd = random.Random(seed)
    return [(start + i, " ".join(rnd.choices(WORDS, weights=[1, 2, 1, 1, 9, 6, 1, 2, 2, 1], k=rnd.randint(0, 30)))) for i in range(n)] + [(start + n, None), (start + n + 1, "THE-cat,THE cat")]


def toks(text):
    return re.findall("[a-z]+", (text or "").lower())


def plain_bm25(docs, terms, k):
    split = {i: toks(t) for i, t in docs.items()}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    out = {}
    for i, t in split.items():
        score = 0.0
        for w in dict.fromkeys(terms):
            df, tf = sum(w in x for x in split.values()), t.count(w)
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) if tf else 0
        if any(w in t for w in terms):
            out[i] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))[:k]


def index_of(spark, rows, range_docs=7):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return X.Index(*X.split(X.build(docs, range_docs).cache()))


def test_ranked_search_equals_plain_scoring_and_skips(spark):
    rows = some_docs(150, 1)
    index = index_of(spark, [*rows, (None, "cat cat")])
    for terms, k in ((["cat", "new"], 5), (["the"], 3), (["york", "york", "zebra"], 400), (["zebra"], 3)):
        assert [tuple(r) for r in index.ranked(terms, k).collect()] == plain_bm25(dict(rows), terms, k)
    rare = [*some_docs(150, 2), *((1000 + i, "cat cat cat cat") for i in range(3))]
    index = index_of(spark, rare)
    assert [tuple(r) for r in index.ranked(["cat"], 3).collect()] == plain_bm25(dict(rare), ["cat"], 3)
    assert index.opened < index.ranges.count() / 2


def test_frontier_bounds_every_score(spark):
    index = index_of(spark, some_docs(80, 3), range_docs=20)
    from pyspark.sql import functions as F

    lens = index.ranges.select("range", F.posexplode("lens").alias("ords", "len"))
    flat = index.blocks.select("term", "range", F.inline(F.arrays_zip("ords", "tfs"))).join(lens, ["range", "ords"])
    for mean in (1.0, 15.0, 200.0):
        best = flat.groupBy("term", "range").agg(F.max(X.impact(F.col("tfs"), F.col("len"), F.lit(mean))).alias("best"))
        bound = index.blocks.select("term", "range", F.array_max(F.transform("frontier", lambda p: X.impact(p["tf"], p["len"], F.lit(mean)))).alias("bound"))
        assert bound.join(best, ["term", "range"]).filter(F.abs(F.col("bound") - F.col("best")) > 1e-12).count() == 0


def test_phrases_and_windows_equal_plain_search(spark):
    rows = some_docs(120, 4)
    index = index_of(spark, rows)
    for phrase in (["new", "york"], ["the", "of", "the"], ["the", "the"], ["cat"], ["zebra", "cat"]):
        want = {}
        for i, t in rows:
            w = toks(t)
            at = [p for p in range(len(w) - len(phrase) + 1) if w[p : p + len(phrase)] == phrase]
            if at:
                want[i] = (len(at), at[0])
        assert {r[0]: (r[1], r[2]) for r in index.matches(phrase).collect()} == want, phrase
    for terms, window in ((["cat", "dog"], 4), (["the", "of", "bird"], 6), (["fish"], 1)):
        want = {}
        for i, t in rows:
            w = toks(t)
            found = []
            for end in range(len(w)):
                last = [max((p for p in range(end + 1) if w[p] == x), default=-1) for x in terms]
                if w[end] in terms and min(last) >= 0 and end - min(last) < window:
                    found.append(min(last))
            if found:
                want[i] = (len(found), min(found))
        assert {r[0]: (r[1], r[2]) for r in index.matches(terms, window).collect()} == want, terms
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shown = X.snippets(index.matches(["new", "york"]), docs, 2).collect()
    assert shown
    for r in shown:
        w = toks(dict(rows)[r["doc_id"]])
        assert r["snippet"] == " ".join(w[max(0, r["first"] - 4) : r["first"] + 6])


def postings(index):
    from pyspark.sql import functions as F

    gone = index.dead.select("range", F.explode("gone").alias("ords"))
    names = index.ranges.select("range", F.posexplode("ids").alias("ords", "doc_id"))
    flat = index.blocks.select("term", "range", F.inline(F.arrays_zip("ords", "tfs"))).join(gone, ["range", "ords"], "left_anti").join(names, ["range", "ords"])
    return sorted(tuple(r) for r in flat.select("term", "doc_id", "tfs").collect())


def wanted(docs):
    return sorted((w, i, toks(t).count(w)) for i, t in docs.items() for w in set(toks(t)))


def test_adding_changing_deleting_and_merging_equal_a_rebuild(spark, tmp_path):
    schema, store = "doc_id long, text string", Snapshots(spark, str(tmp_path / "index"), range_docs=9)
    assert store.open().ranked(["cat"], 3).count() == 0
    rnd, docs, old = random.Random(5), {}, None
    for turn in range(6):
        new = dict(some_docs(20, turn, start=rnd.randrange(40)))
        gone = rnd.sample(range(62), 5)
        store.commit(spark.createDataFrame([*new.items(), (None, "cat")], schema), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        docs = {i: t for i, t in {**docs, **new}.items() if i not in gone}
        if turn == 2:
            old = (store.current(), dict(docs))
        if turn in (3, 5):
            before = len(store.current()["segments"])
            store.merge()
            assert (before, len(store.current()["segments"])) == {3: (4, 1), 5: (3, 3)}[turn]
        index = store.open()
        assert postings(index) == wanted(docs)
        assert [tuple(r) for r in index.ranked(["cat", "york"], 6).collect()] == plain_bm25(docs, ["cat", "york"], 6)
    assert postings(store.open(old[0])) == wanted(old[1])  # who reads an older snapshot sees it whole
    some = {r["doc_id"] for r in store.open().matches(["the", "cat"]).collect()}
    assert some == {i for i, t in docs.items() if "the cat" in " ".join(toks(t))}
    number = store.current()["snapshot"]
    assert store.commit(spark.createDataFrame(list(docs.items()), schema), spark.createDataFrame([(999,)], "doc_id long")) == number  # nothing new
    store.merge(every=True)
    store.vacuum()
    assert len([p for p in (tmp_path / "index").iterdir() if not p.name.startswith(".")]) == 2
    assert postings(store.open()) == wanted(docs)
    row = store.stats().first()
    assert (row["documents"], row["postings"], row["segments"]) == (len(docs), len(wanted(docs)), 1)
    assert row["occurrences"] == sum(len(toks(t)) for t in docs.values())


def test_of_two_writers_the_second_fails(spark, tmp_path):
    store, other = (Snapshots(spark, str(tmp_path / "index")) for _ in range(2))
    rows = spark.createDataFrame([(1, "cat")], "doc_id long, text string")
    state = other.current()
    store.commit(rows)
    with pytest.raises(RuntimeError):
        other._publish({**state, "snapshot": 1})
    assert json.loads((tmp_path / "index" / "snapshot-000000001.json").read_text())["snapshot"] == 1


def test_stream_with_deletes(spark, tmp_path):
    store, schema = Snapshots(spark, str(tmp_path / "index")), "doc_id long, text string, gone boolean"
    for rows in ([(1, "cat cat", None), (2, "dog", False)], [(2, None, True), (3, "bird", None), (1, "cat", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        store.stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "cp"), "gone").awaitTermination()
    assert postings(store.open()) == [("bird", 3, 1), ("cat", 1, 1)]
    batch = store.current()["batch"]
    store.commit(spark.createDataFrame([(9, "late", None)], schema), batch=batch)  # a batch that is written again
    assert postings(store.open()) == [("bird", 3, 1), ("cat", 1, 1)]


def test_same_scores_as_search_without_an_index(spark):
    docs = spark.createDataFrame(some_docs(60, 9), "doc_id long, text string")
    want = [tuple(r) for r in S.top(S.bm25(docs, ["new", "york"]), 8).collect()]
    assert [tuple(r) for r in index_of(spark, some_docs(60, 9)).ranked(["new", "york"], 8).collect()] == want


def test_merging_takes_time_in_proportion_to_the_postings(spark, tmp_path):
    import time

    n = 4000  # one range in which a term has n postings: work by the square of that took minutes
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('cat cat dog w', hex(id)) AS text")
    store = Snapshots(spark, str(tmp_path / "index"))
    store.commit(docs.coalesce(1))
    store.commit(spark.createDataFrame([(1, "cat")], "doc_id long, text string"), spark.createDataFrame([(0,)], "doc_id long"))
    start = time.time()
    store.merge(every=True)
    assert time.time() - start < 40
    assert {r["term"]: r["n"] for r in store.open().blocks.filter("term IN ('cat', 'dog')").collect()} == {"cat": n - 1, "dog": n - 2}
    assert store.open().dead.count() == 0


def test_a_merged_range_is_bounded_by_tokens_too(spark, tmp_path, monkeypatch):
    from weirwork.streaming import snapshots

    monkeypatch.setattr(snapshots, "RANGE_TOKENS", 50)
    store = Snapshots(spark, str(tmp_path / "index"))
    for i in range(3):
        store.commit(spark.createDataFrame([(i, "cat dog " * 30)], "doc_id long, text string"))
    store.merge(every=True)
    assert store.open().ranges.count() == 3
    assert postings(store.open()) == sorted((t, i, 30) for i in range(3) for t in ("cat", "dog"))
