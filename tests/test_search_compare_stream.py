import collections
import json
import math

import numpy as np
from pyspark.sql import functions as F

from weirwork.operators import compare as C
from weirwork.operators import search as S
from weirwork.plans import queries as Q
from weirwork.sources.files import read_bytes, read_manifests, read_yaml
from weirwork.sources.outlines import outline_markdown, read_outlines
from weirwork.sources.registry import lookup_latest
from weirwork.streaming.incremental import clear, compact, export, index_stats, index_stream, read_index, upsert

from .conftest import SMALL


def test_bm25_and_top(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird fish"), (3, None), (4, "dog"), (5, "dog")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in S.bm25(docs, ["cat"]).collect()}
    mean, n, df = 8 / 5, 5, 2
    want = lambda tf, size: round(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 6)
    assert got == {1: want(1, 2), 2: want(2, 4)}
    assert [r["doc_id"] for r in S.top(S.bm25(docs, ["dog"]), 2).collect()] == [4, 5]


def test_hybrid_and_nearest(spark):
    lexical = spark.createDataFrame([(1, 2.0), (2, 1.0)], "doc_id long, score double")
    semantic = spark.createDataFrame([(2, 0.5), (3, 1.0)], "doc_id long, score double")
    assert {r["doc_id"]: r["score"] for r in S.hybrid(lexical, semantic, 0.25).collect()} == {1: 0.75, 2: 0.5, 3: 0.25}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.1])], "vec_id long, embedding array<float>")
    rows = S.nearest(vectors.filter("vec_id = 1"), vectors, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == [2, 4]


def test_nearest_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 8)).astype(np.float32)
    x[200:230] = x[7]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (320, [0.0] * 8), (340, [1.0]), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {q: sorted((i for i in range(300) if i != q), key=lambda i: (-round(unit[q] @ unit[i], 6), i))[:4] for q in range(0, 300, 20)}
    want |= {q: [0, 1, 2, 3] for q in (300, 320, 340)}  # no scores: by id
    got = collections.defaultdict(list)
    for r in S.nearest(vectors.filter("vec_id % 20 = 0"), vectors, 4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
        assert (r["score"] is None) == (r["query_id"] >= 300)
    assert got == want


def test_queries_are_not_broadcast(spark):
    plan = Q.QUERIES["search_nearest"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    found = Q.QUERIES["search_nearest"](spark, SMALL).select("query_id").distinct().count()
    assert found == spark.read.parquet(f"{SMALL}/embeddings.parquet").filter("vec_id % 20 = 0").count() == 25


def test_sections_and_snippets(spark):
    docs = spark.createDataFrame([(1, "a\n\n b\n"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in S.sections(docs).collect()] == [(1, 0, "a"), (1, 2, " b")]
    rows = S.snippets(spark.createDataFrame([(1, "xx Needle yy"), (2, None)], "doc_id long, text string"), ["needle"], 6).orderBy("doc_id").collect()
    assert [r["snippet"] for r in rows] == ["Needle", ""]


def test_edges_and_section_filter(spark):
    docs = spark.createDataFrame([(1, "b a\nb b c"), (2, "c b"), (3, None), (4, "a")], "doc_id long, text string")
    assert sorted(map(tuple, S.edges(docs).collect())) == [("a", "b", 2), ("b", "c", 2)]
    found = S.sections(docs)
    assert sorted(map(tuple, S.filter_sections(found, ["c", "x"]).collect())) == [(1, 1, "b b c"), (2, 0, "c b")]
    assert S.filter_sections(found, []).count() == 0


def test_export_and_index_stats(spark, tmp_path):
    for i, rows in enumerate(([(1, "cat cat"), (2, "dog")], [(2, "cat"), (3, None)])):
        upsert(spark.createDataFrame(rows, "doc_id long, text string"), i, str(tmp_path / "index"))
    stats = index_stats(spark, str(tmp_path / "index"))
    assert stats.first().asDict() == {"documents": 3, "terms": 1, "postings": 2, "occurrences": 3}
    for kind in ("json", "csv", "parquet"):
        export(stats, str(tmp_path / kind), kind)
        back = spark.read.options(header=True, inferSchema=True).format(kind).load(str(tmp_path / kind))
        assert back.select("documents", "terms", "postings", "occurrences").first() == (3, 1, 2, 3)


def test_compare(spark):
    left = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, digest string")
    right = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, digest string")
    assert {r["path"]: r["status"] for r in C.diff_trees(left, right).collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}
    md = spark.createDataFrame([(1, "![A cat](cat.png) and ![](x.jpg \"t\")"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in C.captions(md).collect()] == [(1, 0, "A cat", "cat.png"), (1, 1, "", "x.jpg")]
    edges = spark.createDataFrame([("r", None), ("x", "r"), ("y", "x"), ("p", "q"), ("q", "p")], "node string, parent string")
    assert {r["node"]: (r["depth"], r["path"]) for r in C.hierarchy(edges).collect()} == {"r": (0, "r"), "x": (1, "r/x"), "y": (2, "r/x/y")}


def test_bytes(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "b.jpeg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "c.txt").write_bytes(b"")
    rows = C.wrong_extensions(read_bytes(spark, f"{tmp_path}/*")).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["claimed"], r["found"]) for r in rows] == [("a.jpg", "jpg", "png")]


def test_outlines(spark):
    opml = "<opml><body><outline text='A'><outline text='B'><outline text='C'/></outline><outline text='D'/></outline></body></opml>"
    mind = "<map><node TEXT='R'><node TEXT='S'/></node></map>"
    docs = spark.createDataFrame([("o", opml), ("m", mind), ("bad", "<x"), ("none", None), ("dtd", "<!DOCTYPE a><opml/>")], "path string, text string")
    nodes = read_outlines(docs)
    assert sorted((r["path"], r["node"], r["parent"], r["title"]) for r in nodes.collect() if r["path"] == "o") == [("o", "1", None, "A"), ("o", "1.1", "1", "B"), ("o", "1.1.1", "1.1", "C"), ("o", "1.2", "1", "D")]
    text = {r["path"]: r["markdown"] for r in outline_markdown(nodes).collect()}
    assert text == {"o": "# A\n- B\n  - C\n- D", "m": "# R\n- S"}


def test_manifests_yaml_and_lookup(spark, tmp_path):
    for tier, name, body in ((".one", "a", {"dependencies": {"x": "1.0.0"}}), (".one", "b", {"dependencies": {"y": "^1.0.0"}, "overrides": {"z": "1.0.0"}})):
        (tmp_path / tier / name).mkdir(parents=True)
        (tmp_path / tier / name / "package.json").write_text(json.dumps(body, indent=1))
    rows = read_manifests(spark, f"{tmp_path}/.*/*/package.json").collect()
    assert sorted(str(r["dependencies"]) for r in rows) == ["{'x': '1.0.0'}", "{'y': '^1.0.0'}"]
    (tmp_path / "s.yaml").write_text("a: {b: no}\n")
    doc = read_yaml(spark, f"{tmp_path}/s.yaml").select(F.try_variant_get("document", "$.a.b", "string").alias("b"), "error").first()
    assert (doc["b"], doc["error"]) == ("no", None)

    def fetch(url):
        return (200, url.rsplit("/", 2)[1]) if "bad" not in url else (404, None)

    names = spark.createDataFrame([("@s/p",), ("@s/p",), ("bad",)], "name string")
    found = {r["name"]: (r["http_status"], r["version"]) for r in lookup_latest(names, "http://registry.invalid", fetch, 2).collect()}
    assert found == {"@s/p": (200, "%40s%2Fp"), "bad": (404, None)}


def test_incremental_index(spark, tmp_path):
    src, folder = tmp_path / "in", str(tmp_path / "index")
    schema = "doc_id long, text string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
        index_stream(spark.readStream.schema(schema).json(str(src)), folder, str(tmp_path / "cp")).awaitTermination()

    live = lambda f=folder: sorted(map(tuple, read_index(spark, f).collect()))
    add([(1, "cat cat"), (2, "dog")])
    assert live() == [("cat", 1, 2), ("dog", 2, 1)]
    add([(2, "bird"), (3, None), (1, "cat cat")])
    assert live() == [("bird", 2, 1), ("cat", 1, 2)]
    compact(spark, folder, str(tmp_path / "small"), 2)
    assert live(str(tmp_path / "small")) == live()
    clear(spark, folder)
    assert not (tmp_path / "index").exists()
