import random
import re
from functools import cmp_to_key

from pyspark.sql import functions as F

from weirwork.operators import components as C
from weirwork.operators import versions as V

ORDERED = ["0.0.0-0", "0.0.0", "0.0.9", "0.0.10", "0.1.0-a.b", "0.1.0", "1.0.0-1", "1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "2.0.0"]
NONE = ["1.0", "v1.0.0", "1.0.0+b", "01", "1.0.0-", "1.0.0-a..b", "1.0.0\n", "9" * 19 + ".0.0"]


def parse(v):
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)(?:-(.+))?", v)
    return tuple(map(int, m.groups()[:3])), m[4].split(".") if m[4] else None


def compare(v, w):
    (a, p), (b, q) = parse(v), parse(w)
    if a != b:
        return -1 if a < b else 1
    if p is None or q is None:
        return (p is None) - (q is None)
    for x, y in zip(p, q, strict=False):
        if x != y:
            if x.isdigit() != y.isdigit():
                return -1 if x.isdigit() else 1
            return -1 if ((int(x) < int(y)) if x.isdigit() else x < y) else 1
    return (len(p) > len(q)) - (len(p) < len(q))


def allowed(spec, v):
    """By the words of the docstring, without keys."""
    m = re.fullmatch(r"(\^|~|>=|)(\d\S*)", spec)
    if spec == "*":
        return parse(v)[1] is None
    if not m:
        return False
    low = m[2]
    (a, b, c), pre = parse(low)
    (x, y, z), mine = parse(v)
    if mine is not None and (pre is None or (a, b, c) != (x, y, z)):
        return False
    if compare(v, low) < 0:
        return False
    if m[1] == "":
        return v == low
    if m[1] == "~":
        return (x, y) == (a, b)
    if m[1] == "^":
        return x == a if a else (x, y) == (0, b) if b else (x, y, z) == (0, 0, c)
    return True


SPECS = ["*", "1.0.0", "^1.0.0", "^0.1.0", "^0.0.9", "~1.2.0", "~1.0.0-alpha", "^1.0.0-beta", ">=1.0.0-rc.1", ">=0.0.0", "1.0.0-beta.2", "^9.0.0", "latest", "<2.0.0", "^0.0.0-0"]


def test_keys_order_as_versions_do(spark):
    rnd = random.Random(1)
    shuffled = rnd.sample(ORDERED, len(ORDERED))
    df = spark.createDataFrame([(v,) for v in shuffled + NONE], "version string").withColumn("key", V.version_key(F.col("version")))
    assert [r["version"] for r in df.filter("key IS NOT NULL").orderBy("key").collect()] == ORDERED == sorted(shuffled, key=cmp_to_key(compare))
    assert df.filter("key IS NULL").count() == len(NONE)


def test_greatest_allowed_equals_trying_all(spark):
    rnd = random.Random(2)
    has = {f"p{i}": rnd.sample(ORDERED, rnd.randint(0, len(ORDERED))) for i in range(8)}
    available = spark.createDataFrame([(n, v) for n, vs in has.items() for v in [*vs, *vs[:2], *NONE]] + [(None, "1.0.0")], "name string, version string").repartition(3)
    specs = spark.createDataFrame([(n, s) for n in has for s in SPECS] + [("absent", "*"), (None, "*"), ("p1", None)], "name string, spec string")
    got = {(r["name"], r["spec"]): r["version"] for r in V.greatest_allowed(specs, available).collect()}
    want = {(n, s): max((v for v in vs if allowed(s, v)), key=cmp_to_key(compare), default=None) for n, vs in has.items() for s in SPECS}
    assert got == {**want, ("absent", "*"): None, ("p1", None): None}
    pairs = specs.filter("name IS NOT NULL").join(available, "name").withColumn("key", V.version_key(F.col("version"))).filter("key IS NOT NULL")
    for r in pairs.withColumn("ok", V.allows(V.interval(F.col("spec")), F.col("key"))).collect():
        assert r["ok"] == (r["spec"] is not None and allowed(r["spec"], r["version"]))


def plain_updates(current, declared, available, needs):
    target = {}
    for n, now in current.items():
        specs = {s for m, s in declared if m == n}
        known = [s for s in specs if s == "*" or re.fullmatch(r"(\^|~|>=|)\d+\.\d+\.\d+(-\S+)?", s)]
        fits = [v for m, v in available if m == n and known and all(allowed(s, v) for s in known) and (parse(v)[1] is None or len(known) == 1)]
        best = max(fits, key=cmp_to_key(compare), default=None)
        if best is not None and compare(best, now) > 0:
            target[n] = best
    back = set()
    while True:
        chosen = {n: target[n] if n in target and n not in back else v for n, v in current.items()}
        failed = [(n, d) for n, v, d, s in needs if chosen.get(n) == v and d in chosen and not allowed(s, chosen[d])]
        new = {n if n in target and n not in back else d for n, d in failed if (n in target and n not in back) or (d in target and d not in back)}
        if not new:
            status = {n: "broken" if any(m == n for m, _ in failed) else "rolled back" if n in back else "updated" if n in target else "current" for n in current}
            return sorted((n, v, target.get(n), chosen[n], status[n]) for n, v in current.items())
        back |= new


def test_safe_updates_equal_plain_rounds(spark):
    seen = set()
    for seed in range(4):
        rnd = random.Random(seed)
        names = [f"p{i}" for i in range(14)]
        versions = ["1.0.0", "1.1.0", "1.2.0", "2.0.0", "2.1.0-rc.1"]
        available = [(n, v) for n in names for v in rnd.sample(versions, 3)]
        current = {n: rnd.choice(versions[:2]) for n in names}
        declared = [(n, s) for n in names for s in rnd.sample(["^1.0.0", "*", ">=1.0.0", "~1.1.0", "^2.1.0-rc.1"], rnd.randint(1, 2))]
        needs = [(n, v, rnd.choice(names), rnd.choice(["^1.0.0", "~1.1.0", ">=1.1.0", "*", "^2.0.0"])) for n in names for v in versions for _ in range(rnd.randint(0, 2))]
        frame = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(2)
        got = V.safe_updates(
            frame([*current.items(), (None, "1.0.0")], "name string, version string"), frame(declared * 2, "name string, spec string"), frame(available, "name string, version string"), frame(needs, "name string, version string, dep string, spec string")
        )
        want = plain_updates(current, declared, available, needs)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        seen |= {r[4] for r in want}
    assert seen >= {"updated", "rolled back", "current"}


TEXT = """intro
# A
one
two

- x
- y
### deep
| a | b |
## B ##
> said
# C
```
# not a heading
```
end
```
open"""


def test_component_tree():
    found = list(C.take_apart(TEXT))
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in found] == [
        (0, "paragraph", "", None, ""), (1, "heading", "1", None, "A"), (2, "paragraph", "1", 1, "A"), (3, "list", "1", 1, "A"), (4, "heading", "1.1", 1, "A / deep"), (5, "table", "1.1", 4, "A / deep"),
        (6, "heading", "1.2", 1, "A / B"), (7, "quote", "1.2", 6, "A / B"), (8, "heading", "2", None, "C"), (9, "code", "2", 8, "C"), (10, "paragraph", "2", 8, "C"), (11, "code", "2", 8, "C"),
    ]
    assert found[2][6] == "one\ntwo"
    assert found[9][6] == "```\n# not a heading\n```"


def test_components_of_a_table(spark):
    docs = spark.createDataFrame([("a", TEXT, 1), ("b", None, 2), ("c", "", 3), (None, "# N\nx", 4), ("d", "para", 5)], "doc_id string, text string, level int")
    found = C.components(docs)
    assert found.count() == 12 + 2 + 1
    assert sorted(r["text"] for r in C.of_kinds(found, ["list", "quote"]).collect()) == ["- x\n- y", "> said"]
    assert {r["component"] for r in C.of_kinds(found.filter("doc_id = 'a'"), ["paragraph", "table", "heading"], "1").collect()} == {1, 2, 4, 5, 6}
    rows = {(r["doc_id"], r["number"]): (r["title"], r["components"], r["chars"]) for r in C.contents(found).collect()}
    assert rows["a", "1"] == ("A", 2, 7 + 7)
    assert rows["a", "2"] == ("C", 3, len("```\n# not a heading\n```") + len("end") + len("```\nopen"))
    assert rows[None, "1"] == ("N", 1, 1)
    assert C.components(docs.limit(0)).count() == 0


def test_where_a_value_comes_from(spark):
    from weirwork.operators.config_values import provenance

    fields = spark.createDataFrame(
        [("a", "string", "x", None), ("b", "string", None, None), ("c", "select", "0.5", ["0.1", "0.5"]), ("d", "select", "0.5", ["0.1", "0.5"]), ("e", "file", "${HOME}/f", None), ("f", "file", "${HOME}/${NO}", None), ("g", "string", "x", None), ("h", "boolean", "true", None)],
        "key string, type string, default string, options array<string>",
    )
    selections = spark.createDataFrame([("c", "0.1"), ("d", "0.7"), ("g", ""), ("h", "true"), ("zz", "1")], "key string, value string")
    variables = spark.createDataFrame([("HOME", "/u"), ("HOME", "/a")], "name string, value string")
    got = {r["key"]: (r["value"], r["badge"]) for r in provenance(fields, selections, variables).collect()}
    assert got == {
        "a": ("x", "Default"), "b": (None, "Empty"), "c": ("0.1", "Selected"), "d": ("0.7", "Unresolved"), "e": ("/u/f", "Default"), "f": ("/u/${NO}", "Unresolved"), "g": ("", "Empty"), "h": ("true", "Selected"),
    }
