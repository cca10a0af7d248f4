import json

import pytest
from pyspark.sql import functions as F

from weirwork.functions import text as T
from weirwork.functions.yaml12 import to_json, yaml_to_json


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_parse_version(spark):
    specs = ["1.2.3", "^1.2.3", "1.2.3-rc.1", "~1.2.3", "1.2", "1.2.3+b", "", "1.2.3\n", ">=1.2.3", None, "^^1.2.3"]
    assert column(spark, specs, T.parse_version) == ["1.2.3", "1.2.3", "1.2.3-rc.1", *[None] * 8]


def test_is_identifier(spark):
    names = ["a", "a-b", "a--b", "-a", "A", "a\n", "", None, "a1-2b", "a_b"]
    assert column(spark, names, T.is_identifier) == [True, True, False, False, False, False, False, False, True, False]


def test_frontmatter(spark):
    texts = ["---\nname: x\n---\nbody", "---\nname: x\n---", "name: x", "--- \na\n\n---\n---\n", "---\n---\n", None, "x\n---\na\n---\n"]
    assert column(spark, texts, T.frontmatter) == ["name: x", "name: x", None, "a\n", None, None, None]


def test_paths(spark):
    assert column(spark, ["a/b/c", "c", "a/", None], T.basename) == ["c", "c", "", None]
    assert column(spark, ["a/b/c", "c", "/a"], T.ancestors) == [["a", "a/b"], [], [""]]
    assert column(spark, ["x.md", "x.mdx", None], T.is_markdown) == [True, False, False]
    assert column(spark, ["x", "", None], T.filled) == [True, False, False]


def test_encode_component(spark):
    texts = ["a b", "@scope/pkg", "é", "a+b", "!'()*~-_.", "%"]
    assert column(spark, texts, T.encode_component) == ["a%20b", "%40scope%2Fpkg", "%C3%A9", "a%2Bb", "!'()*~-_.", "%25"]


def test_variant_kinds(spark):
    values = ['{"a":1}', "[1]", '"x"', "null", "1", "1.5", "true", None]
    kind = lambda c: T.variant_kind(F.parse_json(c))
    assert column(spark, values, kind) == ["object", "array", "string", "null", "number", "number", "boolean", None]
    assert column(spark, values, lambda c: T.is_object(F.parse_json(c))) == [True, *[False] * 7]


@pytest.mark.parametrize(
    ("text", "value"),
    [("a: no\nb: on\nc: 012\nd: 0o17\ne: 0x1f\nf: 1e3\n", {"a": "no", "b": "on", "c": 12, "d": 15, "e": 31, "f": 1000.0}), ("- true\n- ~\n- 2020-01-01\n- '1'\n", [True, None, "2020-01-01", "1"]), ("", None)],
)
def test_yaml_core_schema(text, value):
    out, error = to_json(text)
    assert error is None
    assert json.loads(out) == value


def test_yaml_errors(spark):
    for bad in ("a: 1\na: 2\n", "a: [", "a: 1\n---\nb: 2\n"):
        assert to_json(bad)[0] is None
        assert to_json(bad)[1]
    rows = column(spark, ["a: 1", None, "a: ["], yaml_to_json)
    assert [(r["json"], r["error"] is None) for r in rows] == [('{"a": 1}', True), (None, True), (None, False)]
