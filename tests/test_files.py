"""Reading catalogues from files, end to end, and an index that goes on after trouble."""

import json
import re

import pytest
from pyspark.sql import functions as F

from weirwork.functions.yaml12 import to_json
from weirwork.operators import compare as C
from weirwork.operators import dependencies as D
from weirwork.operators import units as U
from weirwork.plans import audit, validate
from weirwork.sources.files import list_tiers, read_manifests, walk
from weirwork.sources.scratch import Tables, cut, shared_dir
from weirwork.streaming import incremental as I


def put(path, body=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body))


def test_the_root_manifest_is_known_as_such(spark, tmp_path):
    top = tmp_path / "a b+c%20d"
    put(top / "package.json", {"devDependencies": {"x": "1.0.0"}, "overrides": {"x": "^2.0.0", "y": "*"}})
    put(top / "units" / ".one" / "u" / "package.json", {"dependencies": {"x": "3.0.0"}, "devDependencies": {"z": "9.0.0"}})
    put(top / "units" / ".one" / "v" / "package.json", {"dependencies": {"x": "3.0.0"}})
    found = read_manifests(spark, "package.json", "units/.*/*/package.json", root=str(top))
    assert sorted(r["manifest"] for r in found.collect()) == ["package.json", "units/.one/u/package.json", "units/.one/v/package.json"]
    rows = D.all_declarations(found)
    assert sorted((r["manifest"], r["name"], r["spec"]) for r in rows.filter("version IS NOT NULL").collect()) == [
        ("package.json", "x", "1.0.0"), ("package.json", "x", "^2.0.0"), ("units/.one/u/package.json", "x", "3.0.0"), ("units/.one/v/package.json", "x", "3.0.0"),
    ]
    assert [r["spec"] for r in D.unsupported(rows).collect()] == ["*"]
    assert D.drift(D.declarations(rows)).isEmpty()
    assert audit.passed_line(D.declarations(rows), found).split(": ")[1] == "1 declared packages across 2 manifests are current."
    outside = tmp_path / "else"
    put(outside / "package.json", {"dependencies": {"x": "4.0.0"}})
    assert read_manifests(spark, f"{outside}/package.json", root=str(top)).first()["manifest"] == f"{outside}/package.json"


def test_only_what_lies_below_a_unit_is_pruned(spark, tmp_path):
    tier = tmp_path / ".system"
    for path in ("dist/UNIT.md", "u/UNIT.md", "u/node_modules/x/UNIT.md", "u/sub/dist/UNIT.md", "_assets/node_modules/a.txt", "node_modules/UNIT.md"):
        put(tier / path)
    (tier / "_assets" / "node_modules" / "link").symlink_to(tmp_path)
    (tier / "linked").symlink_to(tmp_path)
    (tier / "broken").symlink_to(tmp_path / "nowhere")
    put(tier / "dist" / "dist" / "UNIT.md")
    tiers, entries = list_tiers(spark, str(tmp_path), ["system", "curated"])
    rows = {r["path"]: r["kind"] for r in entries.collect()}
    assert rows == {
        "dist": "dir", "dist/UNIT.md": "file", "u": "dir", "u/UNIT.md": "file", "u/sub": "dir", "node_modules": "dir", "node_modules/UNIT.md": "file", "linked": "dirlink", "broken": "link",
        "_assets": "dir", "_assets/node_modules": "dir", "_assets/node_modules/a.txt": "file", "_assets/node_modules/link": "dirlink",
    }
    assert sorted(r["name"] for r in U.buildable(entries.filter(~F.contains("path", F.lit("/")))).collect()) == ["dist", "linked", "node_modules", "u"]
    assert {r["name"]: r["verdict"] for r in U.classify_entries(entries.filter("path IN ('linked', 'broken', 'dist')")).collect()} == {"linked": "link", "broken": "link", "dist": "unit"}
    front = spark.createDataFrame([], "tier string, unit string, error string").select("*", F.parse_json(F.lit("null")).alias("name"), F.parse_json(F.lit("null")).alias("description"))
    said = {r["message"] for r in validate.unit_violations(tiers, entries, front, validate.Layout()).collect()}
    assert "shared assets contain a link or special file: _assets/node_modules/link" in said
    assert "release unit has no README.md: dist" in said
    assert list(walk(str(tier), "system", "broken")) == [("system", "broken", "broken", "link")]


def test_the_first_violation_is_that_of_the_first_name_as_people_sort(spark):
    rows = [(1, 0, "B", 1, "x"), (1, 0, "a", 2, "y"), (1, 0, "a", 1, "z"), (2, 0, "0", 0, "w")]
    found = spark.createDataFrame(rows, "phase int, tier_ordinal int, entry string, check_ordinal int, message string")
    assert validate.first_violation(found).collect() == [(1, 0, "a", 1, "z")]
    assert validate.first_violation(found.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [(".nan", "null"), ("a: [.inf, 1.5, {b: -.INF}]", '{"a": [null, 1.5, {"b": null}]}')])
def test_numbers_that_json_lacks(text, want):
    assert to_json(text) == (want, None)


def test_deep_hierarchies_and_cycles(spark):
    rows = [(0, None), *((i, i - 1) for i in range(1, 150)), (1000, 1001), (1001, 1000), (1002, 1001), (2000, 9999), (3000, None), (3000, 0)]
    got = {(r["node"], r["parent"]): (r["depth"], r["path"]) for r in C.hierarchy(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert len(got) == 152
    assert got[149, 148] == (149, "/".join(map(str, range(150))))
    assert got[3000, None] == (0, "3000")
    assert got[3000, 0] == (1, "0/3000")
    assert C.hierarchy(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_build_report_and_parity(spark):
    units = spark.createDataFrame([("b", "y"), ("a", "z"), ("b", "x")], "tier string, name string")
    tiers = spark.createDataFrame([("a", 1), ("b", 0)], "tier string, ordinal int")
    assert [r["line"] for r in U.built(units, tiers).orderBy("place").collect()] == ["Built x", "Built y", "Built z", "Built 3 units"]
    have = spark.createDataFrame([("u", "f"), ("v", "f"), ("u", "g"), ("u", "g")], "unit string, feature string")
    assert [tuple(r) for r in U.parity(have).collect()] == [("g", 1, 1, ["v"])]


def test_one_version_a_document_and_batch(spark, tmp_path):
    folder = str(tmp_path / "i")
    live = lambda f=folder: sorted(map(tuple, I.read_index(spark, f).collect()))
    rows = spark.createDataFrame([(1, "old", 1), (1, "new new", 2), (1, "older", 0), (2, None, 1), (None, "x", 1)], "doc_id long, text string, at int")
    I.upsert(rows, 0, folder, order_col="at")
    assert live() == [("new", 1, 2)]
    I.upsert(rows, 0, folder, order_col="at")  # a batch once more
    assert live() == [("new", 1, 2)]
    I.upsert(spark.createDataFrame([(3, "b"), (3, "a")], "doc_id long, text string"), 1, folder)
    assert live() == [("b", 3, 1), ("new", 1, 2)]
    assert I.index_stats(spark, folder).first()["documents"] == 3


def test_a_compacted_index_goes_on(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    live = lambda f: sorted(map(tuple, I.read_index(spark, f).collect()))
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    I.upsert(frame((1, "cat"), (2, "dog")), 0, a)
    I.upsert(frame((2, "bird")), 1, a)
    I.compact(spark, a, b, 2)
    I.upsert(frame((1, "cat"), (3, "cow")), 0, b)  # a new stream begins with batch 0
    assert live(b) == [("bird", 2, 1), ("cat", 1, 1), ("cow", 3, 1)]
    assert spark.read.parquet(f"{b}/versions/part=0").count() == 1  # document 1 was not indexed again
    I.upsert(frame((2, "dog")), 1, b)
    assert live(b) == [("cat", 1, 1), ("cow", 3, 1), ("dog", 2, 1)]
    assert live(str(tmp_path / "none")) == []


def test_intermediate_tables_go(spark):
    with Tables(spark, "t") as tables:
        kept = cut(tables.cut(spark.range(3)))
        folder = tables.folder
    assert kept.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert folder.startswith(shared_dir(spark).rstrip("/"))


def test_a_store_is_listed_as_a_mounted_folder_is(spark, tmp_path):
    from weirwork.sources.files import list_store

    tier = tmp_path / ".system"
    for path in ("dist/UNIT.md", "u [1]/UNIT.md", "u [1]/node_modules/x/UNIT.md", "u [1]/sub/dist/UNIT.md", "u [1]/sub/deep/a%20b.txt", "_assets/node_modules/a.txt", "plain.txt"):
        put(tier / path)
    key = lambda r: (r["tier"], r["path"], r["name"], r["kind"])
    mounted, store = (f(spark, str(tmp_path), ["system", "curated"]) for f in (list_tiers, list_store))
    assert sorted(map(tuple, store[0].collect())) == sorted(map(tuple, mounted[0].collect()))
    assert sorted(map(key, store[1].collect())) == sorted(map(key, mounted[1].collect()))
    assert list_store(spark, str(tmp_path), ["none"])[1].count() == 0


def test_hierarchies_write_pieces_of_paths_and_keep_all_ways(spark, monkeypatch):
    from weirwork.sources import scratch

    sizes, plain = [], scratch.Tables.cut

    def cut(self, df):
        out = plain(self, df)
        sizes.append(out.agg(F.sum(F.length("path"))).first()[0] or 0 if "path" in out.columns else 0)
        return out

    monkeypatch.setattr(scratch.Tables, "cut", cut)
    n = 400
    found = C.hierarchy(spark.createDataFrame([(0, None), *((i, i - 1) for i in range(1, n))], "node long, parent long")).collect()
    assert sorted(r["depth"] for r in found) == list(range(n))
    assert all(r["path"] == "/".join(map(str, range(r["node"] + 1))) for r in found)
    assert max(sizes) * 10 < sum(len(r["path"]) for r in found)  # whole paths were written each round
    # a node that is reached in several ways, at one depth and at several, and an edge that is given twice
    edges = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "a"), ("e", "d"), ("f", "e"), ("f", "e")]

    def ways(node):
        return ["a"] if node == "a" else [f"{w}/{node}" for n_, p in edges if n_ == node for w in ways(p)]

    got = C.hierarchy(spark.createDataFrame(edges, "node string, parent string")).collect()
    assert sorted(r["path"] for r in got) == sorted(w for n_ in "abcdef" for w in ways(n_))
    assert all(r["depth"] == r["path"].count("/") and (r["parent"] is None or r["path"].endswith(f"{r['parent']}/{r['node']}")) for r in got)



def test_leaves_of_hierarchies_have_no_pieces_and_rounds_go(spark, monkeypatch):
    from weirwork.sources import scratch

    with_path, held, plain_cut, plain_table = [], [], C.cut, scratch.Tables.cut

    def cut(df):
        out = plain_cut(df)
        with_path.append(out.count() if "path" in out.columns else 0)
        return out

    def table(self, df):
        out = plain_table(self, df)
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        held.append(len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)))
        return out

    monkeypatch.setattr(C, "cut", cut)
    monkeypatch.setattr(scratch.Tables, "cut", table)
    levels = 40
    edges = [(0, None), *((10 * i + k, 10 * (i - 1)) for i in range(1, levels) for k in range(8))]  # 7 leaves on a level
    found = C.hierarchy(spark.createDataFrame(edges, "node long, parent long")).collect()
    way = lambda n: "/".join(map(str, [*range(0, n // 10 * 10, 10), n]))
    assert sorted((r["node"], r["path"]) for r in found) == sorted((n, way(n)) for n, _ in edges)
    assert max(with_path) <= levels  # every leaf had a row with a piece of its own
    assert max(held) <= 2  # the tables of all rounds were held


def test_heads_of_many_files(spark, tmp_path):
    from weirwork.plans.file_queries import write_files
    from weirwork.sources.files import read_heads, remove_below

    rows = spark.createDataFrame([(f"d{i % 3}/sub/f{i}.png", b"0123456789" * i) for i in range(50)] + [("top.txt", b"x")], "path string, body binary")
    folder = str(tmp_path / "many")
    assert write_files(rows, folder) == 51
    got = {r["path"]: (r["size"], bytes(r["content"])) for r in read_heads(spark, folder, 8).collect()}
    assert got == {**{f"d{i % 3}/sub/f{i}.png": (10 * i, (b"0123456789" * i)[:8]) for i in range(50)}, "top.txt": (1, b"x")}
    remove_below(spark, folder)
    assert not (tmp_path / "many").exists()
    assert read_heads(spark, folder).count() == 0


def test_compaction_sorts_a_bounded_number_of_rows_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PART_ROWS", 100)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    I.upsert(spark.range(1000).selectExpr("id AS doc_id", "'cat dog' AS text"), 0, a)
    I.compact(spark, a, b, 2)
    per = I._read(spark, b, "postings", I.POSTINGS).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per <= 300  # a term's thousand rows were in one task
    assert sorted(map(tuple, I.read_index(spark, b).collect())) == sorted((t, i, 1) for i in range(1000) for t in ("cat", "dog"))


def test_an_index_keeps_documents_packed_until_the_live_ones_are_known(spark, tmp_path):
    from collections import Counter

    folder = str(tmp_path / "i")
    texts = {1: "b a B; a-a 9 \u00e9", 2: None, 3: "", 4: "12 --", 5: "x", 6: " ".join(["aa", "a", "ab"] * 500 + ["zz"])}
    I.upsert(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 0, folder)
    want = sorted((t, i, n) for i, text in texts.items() for t, n in Counter(re.findall("[a-z]+", (text or "").lower())).items())
    index = I.read_index(spark, folder)
    assert sorted(map(tuple, index.collect())) == want
    assert spark.read.parquet(f"{folder}/words").count() == len(texts)  # a row for every term was shuffled and kept
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Join")  # terms were joined with the live documents one by one
    I.compact(spark, folder, str(tmp_path / "b"), 2)
    assert sorted(map(tuple, I.read_index(spark, str(tmp_path / "b")).collect())) == want
    assert I.index_stats(spark, str(tmp_path / "b")).first()["documents"] == len(texts)
