"""Domains, categories and assignments: flattening, references, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_identifier, is_object, variant_kind


def flatten_domains(source: DataFrame, column: str = "document") -> DataFrame:
    """domain_id, category_id and whether the category's value is truthy, from a VARIANT with field domain.

    A domain without categories has one row with a null category.
    """
    kind = "map<string,variant>"
    domains = source.select(F.explode(F.try_variant_get(column, "$.domain", kind)).alias("domain_id", "d"))
    pairs = domains.select("domain_id", F.explode_outer(F.try_variant_get("d", "$.categories", kind)).alias("category_id", "c"))
    falsy = F.coalesce(variant_kind(F.col("c")) == "null", F.col("c").isNull()) | F.coalesce(F.to_json("c").isin("false", "0", '""'), F.lit(False))
    return pairs.select("domain_id", "category_id", (~falsy).alias("usable"))


def flatten_assignments(source: DataFrame, column: str = "document") -> DataFrame:
    """unit_id, domain_id, category_id, tags and whether both ids are strings, from field assignments."""
    rows = source.select(F.explode(F.try_variant_get(column, "$.assignments", "map<string,variant>")).alias("unit_id", "a"))
    part = lambda p: F.try_variant_get("a", p, "variant")
    well = (variant_kind(part("$.domain")) == "string") & (variant_kind(part("$.category")) == "string")
    return rows.select(
        "unit_id", F.try_variant_get("a", "$.domain", "string").alias("domain_id"), F.try_variant_get("a", "$.category", "string").alias("category_id"),
        F.try_variant_get("a", "$.tags", "array<string>").alias("tags"), F.coalesce(well, F.lit(False)).alias("complete"), is_object(F.col("a")).alias("is_object"),
    )


def invalid_identifiers(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(~is_identifier(F.col(column))).select(column).distinct()


def unknown_domains(assignments: DataFrame, domains: DataFrame) -> DataFrame:
    """Assignments whose domain does not exist."""
    return assignments.join(domains.select("domain_id").distinct(), "domain_id", "left_anti")


def unknown_categories(assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """Assignments whose category does not exist in their domain, or has no usable value."""
    usable = categories.filter("usable") if "usable" in categories.columns else categories
    return assignments.join(usable.select("domain_id", "category_id").distinct(), ["domain_id", "category_id"], "left_anti")


def coverage(units: DataFrame, assigned: DataFrame, column: str = "unit_id") -> DataFrame:
    """kind ('missing': unit without assignment; 'unknown': assignment without unit) and id, each once."""
    u, a = units.select(column).distinct(), assigned.select(column).distinct()
    missing = u.join(a, column, "left_anti").select(F.lit("missing").alias("kind"), column)
    return missing.unionByName(a.join(u, column, "left_anti").select(F.lit("unknown").alias("kind"), column))


# The wording of the message is part of the result.
def coverage_message(found: DataFrame, column: str = "unit_id") -> DataFrame:
    """One row: the report line with both lists in code-unit order, 'none' for an empty one."""
    part = lambda kind: F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col(column).cast("string")))), ", "), F.lit("")), F.lit("none"))
    text = F.concat(F.lit("Source taxonomy coverage mismatch. Missing: "), part("missing"), F.lit(". Unknown: "), part("unknown"), F.lit("."))
    return found.agg(text.alias("message"), F.count("*").alias("n"))
