"""Safe updates: versions as sortable keys, specs as intervals, the greatest allowed version, and rollback.

A version is `major.minor.patch` with an optional prerelease part. Its key is a struct that compares
as versions do: numbers by value, a prerelease before its release, its parts one by one (numbers
before words, the shorter list first). A spec is an interval of keys: `1.2.3` is that version alone,
`^1.2.3` all up to the next change of the leftmost number that is not zero, `~1.2.3` all up to the
next minor version, `>=1.2.3` all from there, `*` all. A prerelease is only allowed where the spec
names a prerelease of the same three numbers. Semantics are this project's own.

The greatest allowed version is found without pairs of specs and versions: both are sorted by key in
one window a package, and each spec's upper end takes the last version before it.

Defined cases: what is no version, or has a number of more than 18 digits, has a null key, and is
never a candidate; a spec of another form has no interval and allows nothing. Repeated rows are one.
Rows without a name are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Tables, cut

VERSION = r"^([0-9]{1,18})\.([0-9]{1,18})\.([0-9]{1,18})(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?\z"
SPEC = r"^(\^|~|>=|)\s*([0-9]\S*)\z"
PART = "struct<word:boolean,number:long,text:string>"


def _triple(version: Column) -> list[Column]:
    return [F.regexp_extract(version, VERSION, k).cast("long") for k in (1, 2, 3)]


def _key(numbers: list[Column], released: Column, parts: Column) -> Column:
    return F.struct(numbers[0].alias("major"), numbers[1].alias("minor"), numbers[2].alias("patch"), released.alias("released"), parts.alias("parts"))


def version_key(version: Column) -> Column:
    """The sortable key of a version; null for what is none."""
    pre = F.regexp_extract(version, VERSION, 4)
    number = lambda p: p.rlike(r"^[0-9]{1,18}\z")
    parts = F.transform(F.split(pre, r"\."), lambda p: F.struct((~number(p)).alias("word"), F.when(number(p), p.cast("long")).otherwise(0).alias("number"), F.when(number(p), F.lit("")).otherwise(p).alias("text")))
    none = F.array().cast(f"array<{PART}>")
    return F.when(version.rlike(VERSION), _key(_triple(version), pre == "", F.when(pre == "", none).otherwise(parts)))


def interval(spec: Column) -> Column:
    """struct(low, high, closed, pre) of a spec: keys, whether high itself belongs to it, and the three numbers whose prereleases do."""
    sign, version = F.regexp_extract(spec, SPEC, 1), F.regexp_extract(spec, SPEC, 2)
    key, (a, b, c) = version_key(version), _triple(version)
    zero, none = F.lit(0).cast("long"), F.array().cast(f"array<{PART}>")
    # a bound below all prereleases of its three numbers
    before = lambda x, y, z: _key([x, y, z], F.lit(False), none)
    caret = F.when(a > 0, before(a + 1, zero, zero)).when(b > 0, before(a, b + 1, zero)).otherwise(before(a, b, c + 1))
    most = before(F.lit((1 << 63) - 1), zero, zero)
    high = F.when(sign == "^", caret).when(sign == "~", before(a, b + 1, zero)).when(sign == ">=", most).otherwise(key)
    pre = F.when(~key["released"], F.struct(a.alias("major"), b.alias("minor"), c.alias("patch")))
    cast = F.struct(key.alias("low"), high.alias("high"), (sign == "").alias("closed"), pre.alias("pre"))
    every = F.struct(before(zero, zero, zero).alias("low"), most.alias("high"), F.lit(False).alias("closed"), F.lit(None).cast("struct<major:long,minor:long,patch:long>").alias("pre"))
    return F.when(spec == "*", every).when(spec.rlike(SPEC) & key.isNotNull(), cast)


def allows(range_: Column, key: Column) -> Column:
    """Whether an interval holds a version's key."""
    same = F.struct(key["major"].alias("major"), key["minor"].alias("minor"), key["patch"].alias("patch")) == range_["pre"]
    inside = (key >= range_["low"]) & ((key < range_["high"]) | (range_["closed"] & (key == range_["high"])))
    return F.coalesce(inside & (key["released"] | F.coalesce(same, F.lit(False))), F.lit(False))


def _once(tables: Tables, rows: DataFrame, column: str, name: str, made: Column) -> DataFrame:
    """Rows with what is made of a column, which is worked out once for each of its values."""
    values = tables.cut(rows.filter(F.col(column).isNotNull()).select(column).distinct().repartition(column).withColumn(name, made))
    return tables.cut(rows.join(values, column, "left").select(*rows.columns, name))


def greatest_allowed(specs: DataFrame, available: DataFrame) -> DataFrame:
    """name, spec and version: the greatest available version that the spec allows (null if none).

    specs: name, spec. available: name, version. One window over both, by package and key; of a
    package, what meets in a task is its distinct specs and versions. Specs and versions are taken
    apart once each, whatever the number of packages that have them.
    """
    with Tables(specs.sparkSession, "allowed") as tables:
        asked = _once(tables, tables.cut(specs.filter("name IS NOT NULL").select("name", "spec").distinct()), "spec", "range", interval(F.col("spec")))
        there = _once(tables, tables.cut(available.filter("name IS NOT NULL").select("name", "version").distinct()), "version", "key", version_key(F.col("version"))).filter("key IS NOT NULL")
        return cut(_greatest(asked, there))


def _greatest(asked: DataFrame, there: DataFrame) -> DataFrame:
    """The result from distinct specs with their intervals and distinct versions with their keys."""
    none_v, none_s = F.lit(None).cast("string"), F.lit(None).cast(asked.schema["range"].dataType)
    # at equal keys an open end comes before the version, a closed one after it
    ends = asked.filter("range IS NOT NULL").select("name", F.col("range.high").alias("key"), F.when(F.col("range.closed"), 2).otherwise(0).alias("kind"), none_v.alias("version"), "spec", "range")
    both = ends.unionByName(there.select("name", "key", F.lit(1).alias("kind"), "version", none_v.alias("spec"), none_s.alias("range")))
    order = Window.partitionBy("name").orderBy("key", "kind", "version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct("key", "version")
    # a spec that names a prerelease may take one of the same three numbers: of these, too, the last before its end
    same = Window.partitionBy("name", F.struct("numbers.major", "numbers.minor", "numbers.patch")).orderBy("key", "kind", "version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stable = F.last(F.when((F.col("kind") == 1) & F.col("key.released"), here), ignorenulls=True).over(order)
    found = both.withColumn("stable", stable).filter("spec IS NOT NULL")
    pre = ends.filter("range.pre IS NOT NULL").withColumn("numbers", F.col("range.pre"))
    # within those three numbers the end is the spec's own, or lies above them all
    top = F.struct(F.col("numbers.major").alias("major"), F.col("numbers.minor").alias("minor"), F.col("numbers.patch").alias("patch"), F.lit(True).alias("released"), F.array().cast(f"array<{PART}>").alias("parts"))
    pre = pre.withColumn("key", F.least("key", top)).withColumn("kind", F.when(F.col("range.closed"), 2).otherwise(F.lit(0)))
    stage = there.filter("NOT key.released").select("name", "key", F.lit(1).alias("kind"), "version", none_v.alias("spec"), none_s.alias("range"), F.struct("key.major", "key.minor", "key.patch").alias("numbers"))
    early = pre.unionByName(stage).withColumn("early", F.last(F.when(F.col("kind") == 1, here), ignorenulls=True).over(same)).filter("spec IS NOT NULL").select("name", "spec", "early")
    best = found.join(early, ["name", "spec"], "left")
    fits = lambda c: F.when(allows(F.col("range"), F.col(f"{c}.key")), F.col(c))
    chosen = best.select("name", "spec", F.greatest(fits("stable"), fits("early"))["version"].alias("version"))
    return chosen.unionByName(asked.filter("range IS NULL").select("name", "spec", none_v.alias("version")))


def safe_updates(current: DataFrame, declared: DataFrame, available: DataFrame, needs: DataFrame) -> DataFrame:
    """name, current, target, chosen and status of every package.

    current: name, version that is in use. declared: name, spec of whoever uses it. needs: name,
    version, dep, spec: what each version needs of others. The target is the greatest version that
    all declared specs allow, if it is above the current one. Then, in rounds: where a package in its
    chosen version needs another of which the chosen version does not fit, the package goes back to
    its current version, or if it is there already, the other one does. What is back stays back, so
    rounds end. Status: updated, current, rolled back, or broken (a need fails between current versions).
    """
    with Tables(current.sparkSession, "updates") as tables:
        now = current.filter("name IS NOT NULL").groupBy("name").agg(F.max(F.struct(version_key(F.col("version")).alias("key"), F.col("version"))).alias("x")).select("name", F.col("x.version").alias("current"), F.col("x.key").alias("current_key"))
        each = declared.select("name", "spec").distinct()
        ranges = each.withColumn("range", interval(F.col("spec"))).filter("range IS NOT NULL")
        # a version fits all specs if it lies in their intersection: the greatest low end and the least high end
        ends = ranges.groupBy("name").agg(
            F.max("range.low").alias("low"), F.min(F.struct(F.col("range.high").alias("high"), (~F.col("range.closed")).cast("int").alias("open"))).alias("end"), F.collect_set("range.pre").alias("pres"), F.count("*").alias("n")
        )
        there = available.select("name", "version").distinct().withColumn("key", version_key(F.col("version"))).filter("key IS NOT NULL").join(ends.hint("merge"), "name")
        numbers = F.struct(F.col("key.major").alias("major"), F.col("key.minor").alias("minor"), F.col("key.patch").alias("patch"))
        below = (F.col("key") < F.col("end.high")) | ((F.col("end.open") == 0) & (F.col("key") == F.col("end.high")))
        ok = (F.col("key") >= F.col("low")) & below & (F.col("key.released") | ((F.col("n") == 1) & F.array_contains("pres", numbers)))
        best = there.filter(ok).groupBy("name").agg(F.max(F.struct("key", "version")).alias("x")).select("name", F.col("x.version").alias("target"), F.col("x.key").alias("target_key"))
        state = now.join(best.hint("merge"), "name", "left").withColumn("up", F.coalesce((F.col("target_key") > F.col("current_key")) | F.col("current_key").isNull(), F.lit(False)) & F.col("target").isNotNull())
        state = tables.cut(state.withColumns({"back": F.lit(False), "target": F.when(F.col("up"), F.col("target"))}))
        # only needs of versions that may be chosen count; sides that grow with the packages are not broadcast, which a round would do anew
        may = state.select("name", F.explode(F.array_distinct(F.array_compact(F.array("current", "target")))).alias("version"))
        edges = needs.filter("name IS NOT NULL AND dep IS NOT NULL").select("name", "version", "dep", "spec").join(may.hint("merge"), ["name", "version"], "left_semi").distinct()
        edges = _once(tables, tables.cut(edges), "spec", "range", interval(F.col("spec")))
        while True:
            moves = F.col("up") & ~F.col("back")
            chosen = state.select("name", F.when(moves, F.col("target")).otherwise(F.col("current")).alias("version"), moves.alias("movable")).hint("merge")
            other = state.select(F.col("name").alias("dep"), F.when(moves, F.col("target_key")).otherwise(F.col("current_key")).alias("dep_key"), moves.alias("dep_movable")).hint("merge")
            failed = edges.join(chosen, ["name", "version"]).join(other, "dep").filter(~allows(F.col("range"), F.col("dep_key")))
            failed = tables.cut(failed.select(F.when(F.col("movable"), F.col("name")).when(F.col("dep_movable"), F.col("dep")).alias("back"), "name"))
            back = failed.filter("back IS NOT NULL").select(F.col("back").alias("name")).distinct()
            if back.isEmpty():
                broken = failed.select("name").distinct().withColumn("broken", F.lit(True))
                status = F.when(F.col("broken"), "broken").when(F.col("back"), "rolled back").when(F.col("up"), "updated").otherwise("current")
                out = state.join(broken.hint("merge"), "name", "left").select("name", "current", "target", F.when(F.col("up") & ~F.col("back"), F.col("target")).otherwise(F.col("current")).alias("chosen"), status.alias("status"))
                return cut(out)
            state = tables.cut(state.join(back.withColumn("now", F.lit(True)).hint("merge"), "name", "left").withColumn("back", F.col("back") | F.coalesce("now", F.lit(False))).drop("now"))
