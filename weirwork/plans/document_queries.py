"""Queries of safe updates, documents taken apart, the graph of terms, and trees and texts compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import subtrees as D
from ..operators import term_graph as G
from ..operators import versions as V
from ..operators.config_values import provenance
from .queries import TERMS, TOKENS, query
from .tables import table

#: Lines are uses of packages (parts): what they declare, and the versions that there are.
NAME = "concat('pkg-', l_partkey)"
SPEC = "concat(CASE l_returnflag WHEN 'R' THEN '~' WHEN 'A' THEN '' ELSE '^' END, l_linenumber, '.', cast(l_quantity AS INT) % 2, '.0', CASE WHEN l_tax > 0.06 THEN '-rc.1' ELSE '' END)"
VERSION = "concat(l_linenumber, '.', cast(l_quantity AS INT) % 4, '.', l_suppkey % 3, CASE WHEN l_linestatus = 'O' THEN concat('-rc.', l_orderkey % 3) ELSE '' END)"


@query("""
WITH spec AS (
  SELECT DISTINCT 'pkg-' || l_partkey AS name, CASE l_returnflag WHEN 'R' THEN '~' WHEN 'A' THEN '' ELSE '^' END AS sign, l_linenumber AS a, l_quantity::INT % 2 AS b, l_tax > 0.06::DOUBLE AS pre FROM lineitem),
bound AS (
  SELECT name, sign || a || '.' || b || '.0' || CASE WHEN pre THEN '-rc.1' ELSE '' END AS spec, a, b, pre, sign, [a, b, 0, CASE WHEN pre THEN 0 ELSE 1 END, CASE WHEN pre THEN 1 ELSE 0 END] AS low,
         CASE sign WHEN '~' THEN [a, b + 1, 0, -1, 0] WHEN '^' THEN [a + 1, 0, 0, -1, 0] ELSE [a, b, 0, CASE WHEN pre THEN 0 ELSE 1 END, CASE WHEN pre THEN 2 ELSE 1 END] END AS high
  FROM spec),
there AS (
  SELECT DISTINCT 'pkg-' || l_partkey AS name, l_linenumber || '.' || (l_quantity::INT % 4) || '.' || (l_suppkey % 3) || CASE WHEN l_linestatus = 'O' THEN '-rc.' || (l_orderkey % 3) ELSE '' END AS version,
         [l_linenumber, l_quantity::INT % 4, (l_suppkey % 3)::INT, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, CASE WHEN l_linestatus = 'O' THEN (l_orderkey % 3)::INT ELSE 0 END] AS key
  FROM lineitem)
SELECT b.name, b.spec, max_by(t.version, t.key) AS version
FROM bound b LEFT JOIN there t ON t.name = b.name AND t.key >= b.low AND t.key < b.high AND (t.key[4] = 1 OR (b.pre AND t.key[1:3] = [b.a, b.b, 0]))
GROUP BY 1, 2""")
def greatest_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest version of each package that each spec in use allows."""
    lines = table(spark, sf_dir, "lineitem")
    return V.greatest_allowed(lines.selectExpr(f"{NAME} AS name", f"{SPEC} AS spec"), lines.selectExpr(f"{NAME} AS name", f"{VERSION} AS version"))


@query()
def safe_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which packages can be updated together; a line's version needs the package of the order's next line. Tests compare with plain rounds."""
    lines = table(spark, sf_dir, "lineitem")
    uses = lines.selectExpr("l_orderkey", "l_linenumber", f"{NAME} AS name", f"{VERSION} AS version", "concat('^', l_linenumber, '.', cast(l_quantity AS INT) % 2, '.0') AS spec")
    current = uses.groupBy("name").agg(F.min("version").alias("version"))
    declared = current.join(uses.select("name", "spec"), "name").groupBy("name").agg(F.min("spec").alias("spec"))
    after = uses.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("name").alias("dep"), F.col("spec").alias("dep_spec"))
    needs = uses.join(after, ["l_orderkey", "l_linenumber"]).select("name", "version", "dep", F.col("dep_spec").alias("spec"))
    return V.safe_updates(current, declared, uses.select("name", "version"), needs)


@query(r"""
WITH RECURSIVE line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
head AS (
  SELECT doc_id, pos, length(s) % 4 + 1 AS level, regexp_replace(ltrim(s, ' ' || chr(9)), '[ \t]*#*[ \t]*$', '') AS title FROM line WHERE length(trim(s)) > 0 AND length(s) % 3 = 0),
up AS (SELECT h.doc_id, h.pos, h.level, h.title, max(p.pos) AS parent FROM head h LEFT JOIN head p ON p.doc_id = h.doc_id AND p.pos < h.pos AND p.level < h.level GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY pos) AS k FROM up),
tree(doc_id, pos, level, number, path) AS (
  SELECT doc_id, pos, level, k::VARCHAR, title FROM nth WHERE parent IS NULL
  UNION ALL
  SELECT n.doc_id, n.pos, n.level, t.number || '.' || n.k, t.path || ' / ' || n.title FROM nth n JOIN tree t ON n.doc_id = t.doc_id AND n.parent = t.pos)
SELECT doc_id, number, level::INT AS level, path FROM tree""")
def component_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers and paths of all headings; every third length of line stands for a heading."""
    line = "IF(length(trim(l)) > 0 AND length(l) % 3 = 0, concat(repeat('#', length(l) % 4 + 1), ' ', l), l)"
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"array_join(transform(split(coalesce(text, ''), '\\n'), l -> {line}), '\\n') AS text")
    return C.of_kinds(C.components(docs), ["heading"]).select("doc_id", "number", "level", "path")


@query(f"""
WITH tok AS (SELECT {TOKENS} AS t FROM documents),
side AS (SELECT unnest(t[1:len(t) - 1]) AS a, unnest(t[2:len(t)]) AS b FROM tok WHERE len(t) > 1),
pair AS (SELECT least(a, b) AS source, greatest(a, b) AS target, count(*) AS times FROM side WHERE a <> b GROUP BY ALL),
per AS (SELECT term, sum(times) AS total FROM (SELECT source AS term, times FROM pair UNION ALL SELECT target, times FROM pair) GROUP BY term),
scored AS (
  SELECT source, target, times, ln(times * (2 * (SELECT sum(times) FROM pair))::DOUBLE / (x.total::DOUBLE * y.total)) AS pmi
  FROM pair JOIN per x ON x.term = source JOIN per y ON y.term = target WHERE times >= 2)
SELECT source, target, times, round(pmi, 6) AS pmi FROM scored WHERE pmi > 0""")
def term_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.associations(table(spark, sf_dir, "documents")).withColumn("pmi", F.round("pmi", 6))


@query()
def term_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of the terms around those of search_bm25. Tests compare with plain rounds."""
    return G.page_rank(G.associations(table(spark, sf_dir, "documents")), TERMS).withColumn("rank", F.round("rank", 9))


@query()
def tree_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files by source and language; in the second tree German ones lie elsewhere and those of poor quality are changed. Tests compare with a plain model."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    path = lambda *top: F.concat_ws("/", *top, F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), "doc_id")
    poor = labels.filter("quality = 0").select("doc_id", F.lit(True).alias("poor")).distinct()
    right = docs.join(poor, "doc_id", "left").select(F.when(F.col("lang") == "de", path(F.lit("moved"))).otherwise(path()).alias("path"), F.when(F.col("poor"), F.lit("changed")).otherwise(digest).alias("digest"))
    return D.diff_subtrees(docs.select(path().alias("path"), digest.alias("digest")), right)


@query()
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks between each turn of a conversation and the one after it. Tests apply hunks and get the other text."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right"))
    pairs = turns.join(after, ["conv_id", "turn"]).select(F.concat_ws("/", "conv_id", "turn").alias("name"), F.col("text").alias("left"), "right")
    return D.diff_lines(pairs)


@query("""
WITH f AS (
  SELECT 'field-' || p_partkey AS key, CASE p_size % 3 WHEN 0 THEN 'select' ELSE 'string' END AS type, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '${V' || p_size || '}/x' ELSE p_brand END AS dflt, [p_brand, p_type] AS options,
         CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN p_type ELSE p_name END AS chosen, 'V' || p_size AS var, p_size
  FROM part),
r AS (SELECT *, coalesce(chosen, dflt) AS raw FROM f),
v AS (SELECT *, coalesce(contains(raw, '${'), false) AS uses, p_size % 2 = 0 AS given, CASE WHEN contains(raw, '${') AND p_size % 2 = 0 THEN replace(raw, '${' || var || '}', 'v' || p_size) ELSE raw END AS value FROM r)
SELECT key, value, CASE WHEN (uses AND NOT given) OR (type = 'select' AND value <> '' AND NOT list_contains(options, value)) THEN 'Unresolved' WHEN value IS NULL OR value = '' THEN 'Empty' WHEN chosen IS NOT NULL THEN 'Selected' ELSE 'Default' END AS badge
FROM v""")
def config_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for fields with defaults, options and selections; sizes for variables, the even ones given."""
    part = table(spark, sf_dir, "part").withColumn("key", F.concat(F.lit("field-"), "p_partkey"))
    fields = part.selectExpr("key", "IF(p_size % 3 = 0, 'select', 'string') AS type", "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN concat('${V', p_size, '}/x') ELSE p_brand END AS default", "array(p_brand, p_type) AS options")
    chosen = part.selectExpr("key", "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN p_type ELSE p_name END AS value").filter("value IS NOT NULL")
    given = part.filter("p_size % 2 = 0").selectExpr("concat('V', p_size) AS name", "concat('v', p_size) AS value")
    return provenance(fields, chosen, given)
