"""Source validation: all violations with their place in the order of checks; the first is the error.

Phases: 1 tiers and their release units, 2 the taxonomy. Within a tier entries are taken in locale
order, and within an entry checks in the order of this module.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, is_identifier, variant_kind
from ..operators import taxonomy as X
from ..operators import units as U


@dataclass(frozen=True)
class Layout:
    """Names that a catalogue uses; schema and identity are checked if given."""

    tiers: tuple[str, ...] = ("system", "curated", "experimental")
    descriptor: str = "UNIT.md"
    required: tuple[str, ...] = ("README.md", "unit.yaml")
    schema: str | None = None
    identity: dict[str, str] = field(default_factory=dict)
    pruned: tuple[str, ...] = ("node_modules", ".git", "dist")


def _row(phase: int, tier, entry, check: int, message):
    return [F.lit(phase).alias("phase"), tier.alias("tier_ordinal"), entry.alias("entry"), F.lit(check).alias("check_ordinal"), message.alias("message")]


def unit_violations(tiers: DataFrame, entries: DataFrame, front: DataFrame, layout: Layout) -> DataFrame:
    """Violations of tiers (tier, ordinal, present, kind), entries (tier, path, name, kind) and front
    matter (tier, unit, name and description as VARIANT, error) of descriptors."""
    order = tiers.select("tier", "ordinal")
    top = U.classify_entries(entries.filter(~F.contains("path", F.lit("/")))).join(order, "tier")
    units = top.filter("verdict = 'unit'").select("tier", "ordinal", F.col("name").alias("unit"))
    out = [tiers.filter("present AND kind <> 'dir'").select(*_row(1, F.col("ordinal"), F.lit(""), 0, F.concat(F.lit("tier root is not a regular directory: "), "tier")))]
    out.append(top.filter("verdict = 'link'").select(*_row(1, F.col("ordinal"), F.col("name"), 1, F.concat(F.lit("tier contains a link: "), "path"))))
    below = entries.withColumn("unit", F.split("path", "/")[0]).filter(F.contains("path", F.lit("/"))).join(order, "tier")
    shared = below.filter(F.col("unit") == U.SHARED)
    out.append(U.irregular(shared).select(*_row(1, F.col("ordinal"), F.col("unit"), 2, F.concat(F.lit("shared assets contain a link or special file: "), "path"))))
    for k, name in enumerate((layout.descriptor, *layout.required)):
        # each tier's units by themselves: paths are unique within a tier only
        have = entries.filter((F.col("name") == name) & (F.size(F.split("path", "/")) == 2)).select("tier", F.split("path", "/")[0].alias("unit")).distinct()
        out.append(units.join(have, ["tier", "unit"], "left_anti").select(*_row(1, F.col("ordinal"), F.col("unit"), 3 + k, F.concat(F.lit("release unit has no "), F.lit(name), F.lit(": "), "unit"))))
    named = front.join(units, ["tier", "unit"])
    base = 4 + len(layout.required)
    text = lambda c: F.when(variant_kind(F.col(c)) == "string", F.try_variant_get(c, "$", "string"))
    named = named.select("ordinal", "unit", "error", text("name").alias("name"), text("description").alias("description"))
    fail = lambda where, k, say: named.filter(where).select(*_row(1, F.col("ordinal"), F.col("unit"), base + k, F.concat(F.lit(say), F.lit(": "), "unit")))
    good = F.col("error").isNull()
    out.append(fail(~good, 0, "descriptor has no usable frontmatter"))
    out.append(fail(good & ~is_identifier(F.col("name")), 1, "descriptor has an invalid name"))
    out.append(fail(good & ~filled(F.col("description")), 2, "descriptor has no description"))
    out.append(fail(good & is_identifier(F.col("name")) & (F.col("name") != F.col("unit")), 3, "descriptor name must equal its directory name"))
    # a name is reported at each place but the first
    places = named.filter(good & F.col("name").isNotNull()).select("name", "ordinal", "unit")
    firsts = places.groupBy("name").agg(F.min(F.struct("ordinal", "unit")).alias("first"))
    again = places.join(firsts, "name").filter(F.struct("ordinal", "unit") != F.col("first"))
    out.append(again.select(*_row(1, F.col("ordinal"), F.col("unit"), base + 4, F.concat(F.lit("identity occurs more than once: "), "name"))))
    inner = below.filter(F.col("unit") != U.SHARED)
    # below the unit: its own name is never pruned
    pruned = F.arrays_overlap(F.slice(F.split("path", "/"), 2, 1 << 20), F.array(*map(F.lit, layout.pruned)))
    out.append(inner.filter(F.col("kind").isin("link", "dirlink") & ~pruned).join(units.select("tier", "unit"), ["tier", "unit"]).select(*_row(1, F.col("ordinal"), F.col("unit"), base + 5, F.concat(F.lit("release unit contains a link: "), "path"))))
    deep = inner.filter((F.col("name") == layout.descriptor) & (F.size(F.split("path", "/")) > 2) & ~pruned)
    out.append(deep.join(units.select("tier", "unit"), ["tier", "unit"]).select(*_row(1, F.col("ordinal"), F.col("unit"), base + 6, F.concat(F.lit("release unit contains a nested unit: "), "path"))))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def taxonomy_violations(source: DataFrame, units: DataFrame, layout: Layout) -> DataFrame:
    """Violations of a source document (one row, VARIANT column document) against the units (unit_id)."""
    none, domains, assigned = F.lit(0), X.flatten_domains(source), X.flatten_assignments(source)
    say = lambda text, col: F.concat(F.lit(text), F.col(col))
    out = []
    if layout.schema is not None:
        out.append(source.filter(~F.coalesce(F.try_variant_get("document", "$.schema", "string") == layout.schema, F.lit(False))).select(*_row(2, none, F.lit(""), 0, F.lit("invalid source schema"))))
    for name, value in layout.identity.items():
        out.append(source.filter(~F.coalesce(F.try_variant_get("document", f"$.{name}", "string") == value, F.lit(False))).select(*_row(2, none, F.lit(name), 1, F.lit("invalid source identity"))))
    out.append(X.invalid_identifiers(domains, "domain_id").select(*_row(2, none, F.col("domain_id"), 2, say("invalid domain id: ", "domain_id"))))
    out.append(X.invalid_identifiers(domains.filter("category_id IS NOT NULL"), "category_id").select(*_row(2, none, F.col("category_id"), 3, say("invalid category id: ", "category_id"))))
    out.append(X.invalid_identifiers(assigned, "unit_id").select(*_row(2, none, F.col("unit_id"), 4, say("invalid assigned id: ", "unit_id"))))
    out.append(assigned.filter("NOT complete").select(*_row(2, none, F.col("unit_id"), 5, say("assignment must declare domain and category: ", "unit_id"))))
    complete = assigned.filter("complete")
    out.append(X.unknown_domains(complete, domains).select(*_row(2, none, F.col("unit_id"), 6, say("unknown domain of ", "unit_id"))))
    known = complete.join(domains.select("domain_id").distinct(), "domain_id", "left_semi")
    out.append(X.unknown_categories(known, domains).select(*_row(2, none, F.col("unit_id"), 7, say("unknown category of ", "unit_id"))))
    out.append(X.coverage_message(X.coverage(units, assigned)).filter("n > 0").select(*_row(2, none, F.lit(""), 8, F.col("message"))))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def first_violation(found: DataFrame) -> DataFrame:
    """The violation that a check stopping at the first problem would report (no row if there is none).

    One minimum instead of a global sort; entries compare in locale order, as in `in_locale_order`.
    """
    place = F.collate(F.col("entry"), "UNICODE").alias("place")
    key = F.struct("phase", "tier_ordinal", place, "entry", "check_ordinal", "message")
    return found.agg(F.min(key).alias("x")).filter("x IS NOT NULL").select("x.phase", "x.tier_ordinal", "x.entry", "x.check_ordinal", "x.message")


def in_locale_order(rows: DataFrame, column: str) -> DataFrame:
    """Sorted as people sort names: case and punctuation weigh less than letters."""
    return rows.orderBy(F.collate(F.col(column), "UNICODE"), column)


def json_summary(totals: DataFrame, tiers: DataFrame) -> DataFrame:
    """One row: the summary as indented JSON; totals come from tier_totals."""
    order = totals.filter("tier IS NOT NULL").join(tiers.select("tier", "ordinal"), "tier")
    roots = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "tier", "present", "releaseUnitCount"))), lambda r: F.struct(r["tier"].alias("tier"), r["present"].alias("present"), r["releaseUnitCount"].alias("releaseUnitCount")))
    summary = order.agg(roots.alias("roots"), F.struct(F.sum("releaseUnitCount").alias("releaseUnitCount")).alias("totals"))
    return summary.select(F.to_json(F.struct("roots", "totals"), {"pretty": "true"}).alias("summary"))
