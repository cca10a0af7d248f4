from pyspark.sql import functions as F

from weirwork.functions.yaml12 import to_json
from weirwork.operators import taxonomy as X
from weirwork.operators import units as U
from weirwork.plans import validate
from weirwork.schemas import DIR_ENTRY
from weirwork.sources.files import list_tiers, read_documents, read_frontmatter

YAML = """
schema: s/v1
domain:
  docs:
    categories:
      search: {label: Search}
      broken: null
  Bad:
    categories: {}
assignments:
  one: {domain: docs, category: search, tags: [a, b]}
  two: {domain: docs, category: broken}
  three: {domain: nowhere, category: search}
  four: {domain: docs}
  five: {domain: docs, category: constructor}
"""


def source(spark, text=YAML):
    return spark.createDataFrame([(to_json(text)[0],)], "j string").select(F.parse_json("j").alias("document"))


def test_flatten(spark):
    domains = {(r["domain_id"], r["category_id"]): r["usable"] for r in X.flatten_domains(source(spark)).collect()}
    assert domains == {("docs", "search"): True, ("docs", "broken"): False, ("Bad", None): False}
    rows = {r["unit_id"]: r for r in X.flatten_assignments(source(spark)).collect()}
    assert rows["one"]["tags"] == ["a", "b"]
    assert [k for k, r in rows.items() if not r["complete"]] == ["four"]


def test_taxonomy_violations(spark):
    units = spark.createDataFrame([("one",), ("six",)], "unit_id string")
    layout = validate.Layout(schema="s/v2", identity={"sourceId": "x"})
    found = validate.taxonomy_violations(source(spark), units, layout)
    text = sorted(r["message"] for r in found.collect())
    assert text == [
        "Source taxonomy coverage mismatch. Missing: six. Unknown: five, four, three, two.", "assignment must declare domain and category: four", "invalid domain id: Bad",
        "invalid source identity", "invalid source schema", "unknown category of five", "unknown category of two", "unknown domain of three",
    ]
    assert validate.first_violation(found).first()["message"] == "invalid source schema"


def test_coverage_message_without_gaps(spark):
    ids = spark.createDataFrame([("a",)], "unit_id string")
    assert X.coverage_message(X.coverage(ids, ids)).first()["message"] == "Source taxonomy coverage mismatch. Missing: none. Unknown: none."


def unit(root, tier, name, front="---\nname: {0}\ndescription: d\n---\n", files=("README.md", "unit.yaml")):
    d = root / f".{tier}" / name
    d.mkdir(parents=True)
    if front is not None:
        (d / "UNIT.md").write_text(front.format(name))
    for f in files:
        (d / f).write_text("x")
    return d


def test_unit_violations(spark, tmp_path):
    unit(tmp_path, "system", "good")
    unit(tmp_path, "system", "Nope")
    unit(tmp_path, "system", "other", front="---\nname: else\ndescription: d\n---\n")
    unit(tmp_path, "system", "silent", front="---\nname: silent\ndescription: ''\n---\n")
    unit(tmp_path, "system", "plain", front="no front matter")
    unit(tmp_path, "system", "lacking", files=("README.md",))
    unit(tmp_path, "system", "_other")
    unit(tmp_path, "curated", "good")
    deep = unit(tmp_path, "curated", "holder")
    for inner in ("sub", "dist/sub"):
        (deep / inner).mkdir(parents=True)
        (deep / inner / "UNIT.md").write_text("x")
    (tmp_path / ".curated" / "_assets").mkdir()
    (tmp_path / ".curated" / "_assets" / "link").symlink_to(tmp_path)
    (tmp_path / ".curated" / ".hidden").mkdir()
    (tmp_path / ".curated" / "note.txt").write_text("x")
    layout = validate.Layout()
    tiers, entries = list_tiers(spark, str(tmp_path), layout.tiers)
    docs = read_documents(spark, f"{tmp_path}/.*/*/UNIT.md")
    parts = F.split("path", "/")
    front = read_frontmatter(docs).select(F.substring(F.element_at(parts, -3), 2, 99).alias("tier"), F.element_at(parts, -2).alias("unit"), "name", "description", "error")
    found = validate.unit_violations(tiers, entries, front, layout)
    got = sorted((r["tier_ordinal"], r["entry"], r["message"].split(":")[0]) for r in found.collect())
    assert got == [
        (0, "Nope", "descriptor has an invalid name"), (0, "_other", "descriptor has an invalid name"), (0, "lacking", "release unit has no unit.yaml"),
        (0, "other", "descriptor name must equal its directory name"), (0, "plain", "descriptor has no usable frontmatter"), (0, "silent", "descriptor has no description"),
        (1, "_assets", "shared assets contain a link or special file"), (1, "good", "identity occurs more than once"), (1, "holder", "release unit contains a nested unit"),
    ]
    totals = U.tier_totals(tiers, U.classify_entries(entries.filter(~F.contains("path", F.lit("/")))).filter("verdict = 'unit'"))
    assert {r["tier"]: (r["present"], r["releaseUnitCount"]) for r in totals.collect()} == {"system": (True, 7), "curated": (True, 2), "experimental": (False, 0), None: (True, 9)}
    summary = validate.json_summary(totals, tiers).first()["summary"]
    assert '"tier" : "experimental"' in summary
    assert summary.index("system") < summary.index("curated") < summary.index("experimental")


def test_nested_and_missing(spark):
    units = spark.createDataFrame([("t/a",), ("t/b",)], "unit string")
    markers = spark.createDataFrame([("t/a",), ("t/a/x",), ("t/a/dist/y",), ("t/ab",), ("t/b/c/d",)], "path string")
    assert sorted(map(tuple, U.nested_units(units, markers, ["dist"]).collect())) == [("t/a", "t/a/x"), ("t/b", "t/b/c/d")]
    files = spark.createDataFrame([("t/a/R",)], "path string")
    assert sorted(map(tuple, U.missing_files(units, files, ["R"]).collect())) == [("t/b", "R")]


def test_sort_orders(spark):
    names = spark.createDataFrame([("A",), ("_x",), ("a",), ("b",)], "name string")
    assert [r[0] for r in names.orderBy("name").collect()] == ["A", "_x", "a", "b"]
    assert [r[0] for r in validate.in_locale_order(names, "name").collect()] == ["_x", "a", "A", "b"]


def test_entries(spark):
    rows = [("t", ".x", ".x", "link"), ("t", "l", "l", "link"), ("t", "f", "f", "file"), ("t", "_assets", "_assets", "dir"), ("t", "_o", "_o", "dir"), ("t", "u", "u", "dir")]
    entries = spark.createDataFrame(rows, DIR_ENTRY)
    assert {r["name"]: r["verdict"] for r in U.classify_entries(entries).collect()} == {".x": "skip", "l": "link", "f": "not_dir", "_assets": "shared", "_o": "unit", "u": "unit"}
    assert [r["name"] for r in U.buildable(entries).collect()] == ["u"]
