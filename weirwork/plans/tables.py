"""Catalogue-shaped views of the star-schema tables, so that every operator runs at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["UNIT.md", "README.md", "unit.yaml"]
PRUNED = ["node_modules", ".git", "dist"]
DESCRIPTOR = "UNIT.md"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifests(spark: SparkSession, sf_dir: str, root_parts: int = 64) -> DataFrame:
    """Suppliers are manifests (every fiftieth is the root), parts are packages, lines are entries.

    The root has a share of all entries, so it comes in parts, a row each, by hash of the name (all operators take a
    manifest in several rows).
    """
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "if(l_suppkey % 50 = 0, 'package.json', concat('units/u', l_suppkey, '/package.json')) AS manifest",
        "element_at(array('dependencies', 'devDependencies', 'overrides'), l_linenumber % 3 + 1) AS section",
        "concat('pkg-', l_partkey) AS name",
        "concat(CASE l_returnflag WHEN 'R' THEN '~' WHEN 'A' THEN '' ELSE '^' END, l_linenumber, '.', cast(l_quantity AS INT) % 2, '.0') AS spec",
    )
    one = rows.groupBy("manifest", "section", "name").agg(F.min("spec").alias("spec"))
    part = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("section") == s, F.struct("name", "spec")))).alias(s)
    piece = F.when(F.col("manifest") == "package.json", F.pmod(F.xxhash64("name"), F.lit(root_parts))).otherwise(F.lit(0).cast("long"))
    return one.groupBy("manifest", piece.alias("piece")).agg(*map(part, ("dependencies", "devDependencies", "overrides"))).drop("piece")


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('pkg-', p_partkey) AS name", "if(p_size % 10 = 0, 404, 200) AS http_status", "if(p_size % 10 = 1, NULL, concat(p_size % 7 + 1, '.', p_size % 2, '.0')) AS version"
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are domains, nations their categories; every ninth nation has no usable value."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).selectExpr("lower(r_name) AS domain_id", "replace(lower(n_name), '_', '-') AS category_id", "n_nationkey % 9 <> 8 AS usable")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are assigned to the region and nation of their key, some of them wrongly."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    placed = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return placed.selectExpr(
        "lower(replace(s_name, '#', '-')) AS unit_id",
        "CASE WHEN s_suppkey % 7 = 0 THEN 'nowhere' WHEN s_suppkey % 5 = 0 THEN 'asia' ELSE lower(r_name) END AS domain_id",
        "replace(lower(n_name), '_', '-') AS category_id",
    )


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments are tiers; one more is absent."""
    there = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tier")).distinct().withColumn("present", F.lit(True))
    absent = spark.createDataFrame([("ABSENT", False)], "tier string, present boolean")
    return there.unionByName(absent)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are files of units (customers): descriptors, required files, nested and pruned ones."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('u', o_custkey) AS unit",
        "concat('u', o_custkey, '/', element_at(array('UNIT.md', 'README.md', 'unit.yaml', 'sub/UNIT.md', 'dist/UNIT.md', 'notes.txt'), cast(o_orderkey % 6 AS INT) + 1)) AS path",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are directory entries of every kind of name."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS tier",
        "element_at(array(concat('.hidden-', event_id), '_assets', concat('_other-', event_id), concat('unit-', user_id), concat('Unit-', event_id)), cast(event_id % 5 AS INT) + 1) AS name",
        "element_at(array('dir', 'link', 'file', 'other'), cast(event_id % 4 AS INT) + 1) AS kind",
    ).withColumn("path", F.concat_ws("/", "tier", "name"))
