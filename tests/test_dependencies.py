from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weirwork.operators import dependencies as D
from weirwork.plans import audit
from weirwork.schemas import DECLARATION, LATEST

MANIFESTS = "manifest string, dependencies map<string,string>, devDependencies map<string,string>, overrides map<string,string>"


def manifests(spark, *rows):
    return spark.createDataFrame(list(rows), MANIFESTS)


def declared(spark, *rows):
    return D.declarations(D.all_declarations(manifests(spark, *rows)))


def test_sections(spark):
    rows = declared(spark, ("package.json", {"a": "1.0.0"}, {"b": "^1.0.0"}, {"b": "2.0.0"}), ("u/package.json", {"c": "1.0.0"}, {"d": "1.0.0"}, None), ("v/package.json", None, None, None))
    assert sorted(map(tuple, rows.collect())) == [("package.json", "a", "1.0.0", "1.0.0"), ("package.json", "b", "2.0.0", "2.0.0"), ("package.json", "b", "^1.0.0", "1.0.0"), ("u/package.json", "c", "1.0.0", "1.0.0")]


def test_unsupported(spark):
    rows = D.all_declarations(manifests(spark, ("u/package.json", {"a": "~1.0.0", "b": "1.0.0\n", "c": "", "d": "1.0.0"}, None, None)))
    assert sorted(r["name"] for r in D.unsupported(rows).collect()) == ["a", "b", "c"]
    assert [r["name"] for r in D.declarations(rows).collect()] == ["d"]


def test_drift_is_by_spec_and_without_the_root(spark):
    found = D.drift(declared(spark, ("b/package.json", {"x": "^1.0.0", "y": "1.0.0"}, None, None), ("a/package.json", {"x": "1.0.0", "y": "1.0.0"}, None, None), ("c/package.json", {"x": "1.0.0"}, None, None), ("package.json", {"y": "2.0.0"}, None, None)))
    assert [tuple(r) for r in found.collect()] == [("x", 2, "shared dependency drift for x: 1.0.0 in a/package.json, c/package.json; ^1.0.0 in b/package.json")]


def test_currency_counts(spark):
    rows = declared(spark, ("a/package.json", {"x": "1.0.0", "y": "1.0.0", "z": "1.0.0", "w": "1.0.0"}, None, None), ("b/package.json", {"x": "1.0.0", "y": "1.0.0", "z": "1.0.0"}, None, None))
    latest = spark.createDataFrame([("x", 500, None), ("y", 200, "2.0.0"), ("z", 200, None)], LATEST)
    kinds = sorted(r["kind"] for r in D.currency(rows, latest).collect())
    assert kinds == ["lookup", "lookup", "no_version", "outdated", "outdated"]  # x and w once a name, y once a declaration


def test_report_and_status(spark):
    latest = spark.createDataFrame([("x", 200, "1.0.0")], LATEST)
    good = manifests(spark, ("a/package.json", {"x": "1.0.0"}, None, None))
    assert audit.exit_status(audit.violations(good, latest)) == 0
    assert audit.passed_line(D.declarations(D.all_declarations(good)), good) == "Dependency currency audit passed: 1 declared packages across 1 manifests are current."
    bad = audit.violations(manifests(spark, ("b/package.json", {"y": "x"}, None, None), ("a/package.json", {"x": "2.0.0"}, None, None)), latest)
    assert audit.exit_status(bad) == 1
    lines = [r["line"] for r in audit.report(bad).collect()]
    assert lines == sorted(lines)
    assert lines[0] == "Dependency currency violation: a/package.json: x declares 2.0.0; npm latest is 1.0.0"


def test_empty(spark):
    none = spark.createDataFrame([], DECLARATION)
    assert D.drift(none).count() == 0
    assert D.currency(none, spark.createDataFrame([], LATEST)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["package.json", "a", "b", "c"]), st.sampled_from("xyz"), st.sampled_from(["1.0.0", "^1.0.0", "2.0.0", "~1"])), max_size=20))
def test_drift_against_plain_python(spark, entries):
    by_manifest: dict = defaultdict(dict)
    for m, n, s in entries:
        by_manifest[m][n] = s
    specs: dict = defaultdict(lambda: defaultdict(list))
    for m in sorted(by_manifest):
        for n, s in by_manifest[m].items():
            if m != "package.json" and s != "~1":
                specs[n][s].append(m)
    want = {n: {s: sorted(ms) for s, ms in x.items()} for n, x in specs.items() if len(x) > 1}
    rows = manifests(spark, *((m, d, None, None) for m, d in by_manifest.items()))
    got = {}
    for r in D.drift(D.declarations(D.all_declarations(rows))).collect():
        got[r["name"]] = {p.split(" in ")[0]: p.split(" in ")[1].split(", ") for p in r["message"].split(": ", 1)[1].split("; ")}
    assert got == want
