"""Dependency declarations: sections, versions, drift, currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_version

ROOT = "package.json"
# The wording of the messages below is part of the results.


def all_declarations(manifests: DataFrame, root: str = ROOT) -> DataFrame:
    """manifest, name, spec and version of every entry; version is null where the spec is not supported.

    The root manifest declares in all three sections, others in dependencies only. A missing
    section is an empty one. The same name in two sections gives two rows.
    """
    empty = F.create_map().cast("map<string,string>")
    section = lambda c: F.coalesce(F.col(c), empty)
    sections = F.when(F.col("manifest") == root, F.array(section("dependencies"), section("devDependencies"), section("overrides"))).otherwise(F.array(section("dependencies")))
    rows = manifests.select("manifest", F.explode(sections).alias("entries")).select("manifest", F.explode("entries").alias("name", "spec"))
    return rows.withColumn("version", parse_version(F.col("spec")))


def declarations(rows: DataFrame) -> DataFrame:
    return rows.filter("version IS NOT NULL")


def unsupported(rows: DataFrame) -> DataFrame:
    """manifest, name, spec and message of entries whose spec is not supported."""
    message = F.concat(F.col("manifest"), F.lit(": "), F.col("name"), F.lit(" has unsupported dependency spec "), F.coalesce("spec", F.lit("null")))
    return rows.filter("version IS NULL").select("manifest", "name", "spec", message.alias("message"))


def _joined(items: Column, separator: str) -> Column:
    return F.array_join(F.array_sort(items), separator)


def drift(declared: DataFrame, root: str = ROOT) -> DataFrame:
    """name, n_specs and message of packages that manifests other than the root declare by different specs.

    Specs are compared as written. Each spec's manifests, and the specs, stand in code-unit order.
    """
    per_spec = declared.filter(F.col("manifest") != root).groupBy("name", "spec").agg(_joined(F.collect_list("manifest"), ", ").alias("manifests"))
    per_name = per_spec.groupBy("name").agg(F.count("*").alias("n_specs"), _joined(F.collect_list(F.concat("spec", F.lit(" in "), "manifests")), "; ").alias("detail"))
    return per_name.filter("n_specs >= 2").select("name", "n_specs", F.concat(F.lit("shared dependency drift for "), "name", F.lit(": "), "detail").alias("message"))


def by_name(declared: DataFrame) -> DataFrame:
    """name and its declarations (manifest, spec, version), in code-unit order."""
    return declared.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("manifest", "spec", "version"))).alias("declarations"))


def audit_counts(declared: DataFrame, manifests: DataFrame, root: str = ROOT) -> DataFrame:
    """One row: distinct packages declared, and manifests other than the root."""
    return declared.agg(F.countDistinct("name").alias("n_packages")).join(manifests.filter(F.col("manifest") != root).agg(F.count("*").alias("n_manifests")))


def currency(declared: DataFrame, latest: DataFrame) -> DataFrame:
    """name, kind and message: one row a package that could not be looked up, one a declaration that is not current.

    latest: name, http_status, version; one row a package. A package without a row counts as HTTP 404.
    """
    names = declared.select("name").distinct()
    found = names.join(latest, "name", "left").select("name", F.coalesce("http_status", F.lit(404)).alias("http_status"), F.col("version").alias("latest"))
    ok = F.col("http_status").between(200, 299)
    failed = found.filter(~ok).select("name", F.lit("lookup").alias("kind"), F.concat("name", F.lit(": registry lookup failed with HTTP "), F.col("http_status").cast("string")).alias("message"))
    blank = found.filter(ok & F.col("latest").isNull()).select("name", F.lit("no_version").alias("kind"), F.concat("name", F.lit(": registry response has no latest version")).alias("message"))
    old = declared.join(found.filter(ok & F.col("latest").isNotNull()), "name").filter("version <> latest")
    text = F.concat("manifest", F.lit(": "), "name", F.lit(" declares "), "version", F.lit("; npm latest is "), "latest")
    return failed.unionByName(blank).unionByName(old.select("name", F.lit("outdated").alias("kind"), text.alias("message")))
