"""Dependency currency audit: everything that is wrong, sorted, with an exit status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dependencies as D

HEAD = "Dependency currency violation: "


def violations(manifests: DataFrame, latest: DataFrame, root: str = D.ROOT) -> DataFrame:
    """kind and message of unsupported specs, drift, and packages that are not current."""
    rows = D.all_declarations(manifests, root)
    declared = D.declarations(rows)
    parts = [
        D.unsupported(rows).select(F.lit("unsupported").alias("kind"), "message"),
        D.drift(declared, root).select(F.lit("drift").alias("kind"), "message"),
        D.currency(declared, latest).select("kind", "message"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report(found: DataFrame) -> DataFrame:
    """The lines to print, in code-unit order."""
    return found.select(F.concat(F.lit(HEAD), "message").alias("line")).orderBy("line")


def exit_status(found: DataFrame) -> int:
    return 0 if found.isEmpty() else 1


def passed_line(declared: DataFrame, manifests: DataFrame) -> str:
    row = D.audit_counts(declared, manifests).first()
    return f"Dependency currency audit passed: {row['n_packages']} declared packages across {row['n_manifests']} manifests are current."
