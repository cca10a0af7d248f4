"""Release units: listing filters, required files, duplicates, nesting, totals per tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, join_path
from ..sources.files import SHARED


def classify_entries(entries: DataFrame) -> DataFrame:
    """entries with verdict: skip, link, not_dir, shared or unit; hidden names first, then links (of both kinds), then kinds."""
    verdict = (
        F.when(F.startswith("name", F.lit(".")), "skip")
        .when(F.col("kind").isin("link", "dirlink"), "link")
        .when(F.col("kind") != "dir", "not_dir")
        .when(F.col("name") == SHARED, "shared")
        .otherwise("unit")
    )
    return entries.withColumn("verdict", verdict)


def buildable(entries: DataFrame) -> DataFrame:
    """Directories, also linked ones, whose names start with neither a dot nor an underscore: tier, name, path."""
    return entries.filter(F.col("kind").isin("dir", "dirlink") & ~F.startswith("name", F.lit(".")) & ~F.startswith("name", F.lit("_"))).select("tier", "name", "path")


def built(units: DataFrame, tiers: DataFrame) -> DataFrame:
    """place (from 0) and line of the report of a build: tier by tier, names in code-unit order, then the total.

    units: tier, name; tiers: tier, ordinal. Places come from counts per tier and a numbering within each.
    """
    order = units.join(tiers.select("tier", "ordinal"), "tier")
    counts = order.groupBy("ordinal").agg(F.count("*").alias("n"))
    before = counts.select("ordinal", F.coalesce(F.sum("n").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a tier
    within = F.row_number().over(Window.partitionBy("ordinal").orderBy("name"))
    lines = order.join(before, "ordinal").select((F.col("base") + within - 1).alias("place"), F.concat(F.lit("Built "), "name").alias("line"))
    total = order.agg(F.count("*").alias("n")).select(F.col("n").alias("place"), F.concat(F.lit("Built "), F.col("n").cast("string"), F.lit(" units")).alias("line"))
    return lines.unionByName(total)


def parity(features: DataFrame, unit: str = "unit", feature: str = "feature") -> DataFrame:
    """feature, n_with, n_without and the units without it, of features that some units have and others lack."""
    have = features.select(F.col(unit).alias("unit"), F.col(feature).alias("feature")).distinct()
    n = have.select("unit").distinct().count()
    some = have.groupBy("feature").agg(F.count("*").alias("n_with")).filter(F.col("n_with") < n)
    every = some.agg(F.array_sort(F.collect_list("feature")).alias("every"))  # one row: the features are few
    own = have.groupBy("unit").agg(F.collect_set("feature").alias("own"))
    lacking = own.join(F.broadcast(every)).select("unit", F.explode(F.array_except("every", "own")).alias("feature"))
    without = lacking.groupBy("feature").agg(F.count("*").alias("n_without"), F.array_sort(F.collect_list("unit")).alias("without"))
    return some.join(without, "feature").select("feature", "n_with", "n_without", "without")


def irregular(entries: DataFrame) -> DataFrame:
    """Entries of shared assets that are neither files nor directories."""
    return entries.filter(~F.col("kind").isin("file", "dir"))


def missing_files(units: DataFrame, entries: DataFrame, required: list[str]) -> DataFrame:
    """unit and file for every required file that is not listed. units: unit (path); entries: path."""
    wanted = units.select("unit", F.explode(F.array(*map(F.lit, required))).alias("file")).withColumn("path", join_path(F.col("unit"), F.col("file")))
    return wanted.join(entries.select("path").distinct(), "path", "left_anti").select("unit", "file")


def duplicates(units: DataFrame, column: str = "name") -> DataFrame:
    """Identities that occur more than once, and how often."""
    return units.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def nested_units(units: DataFrame, markers: DataFrame, pruned: list[str]) -> DataFrame:
    """unit and nested: directories below a unit that themselves hold the descriptor file.

    markers: path of every directory with a descriptor. Each marker meets its ancestors by equality,
    so no path is compared with all others. Directories below a pruned name do not count.
    """
    below = markers.select(F.col("path").alias("nested"), F.explode(ancestors(F.col("path"))).alias("unit"))
    inner = F.expr("split(substring(nested, length(unit) + 2), '/')")
    return below.join(units.select("unit"), "unit", "left_semi").filter(~F.arrays_overlap(inner, F.array(*map(F.lit, pruned)))).select("unit", "nested")


def tier_totals(tiers: DataFrame, units: DataFrame) -> DataFrame:
    """tier, present, releaseUnitCount of every tier (zeros kept) and a row with null tier for the total."""
    counted = tiers.select("tier", "present").join(units.select("tier", F.lit(1).alias("one")), "tier", "left")
    return counted.rollup("tier").agg(F.bool_or("present").alias("present"), F.count("one").alias("releaseUnitCount"))
