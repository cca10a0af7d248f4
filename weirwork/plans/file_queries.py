"""Queries that read files: views of the tables are written below the shared folder and read back by the file sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import dependencies as D
from ..operators import search as S
from ..operators import taxonomy as X
from ..operators import units as U
from ..sources import files, outlines, registry
from ..sources.scratch import cut, new_folder, remove
from ..streaming import incremental
from . import audit, validate
from . import tables as V
from .queries import ENTRIES, ENTRY_SQL, TAXONOMY, TERMS, TOKENS, query
from .tables import table

LAYOUT = validate.Layout()


def _local(folder: str) -> str:
    return re.sub("^file:/+", "/", folder)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write rows (path, body) as files below a folder of any store that Arrow can write to; how many there are."""

    def run(found: Iterator[Row]) -> Iterator[int]:
        store, top = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + _local(folder))
        n, made = 0, None
        for path, body in found:
            name = f"{top}/{path}"
            above = name.rpartition("/")[0]
            if above != made:
                store.create_dir(above, recursive=True)
                made = above
            with store.open_output_stream(name) as f:
                f.write(body.encode() if isinstance(body, str) else bytes(body))
            n += 1
        yield n

    # rows come pickled, some megabytes at a time, whereas an Arrow batch has a number of rows of any size
    return rows.select("path", "body").rdd.mapPartitions(run).sum()


def from_files(spark: SparkSession, rows: DataFrame, read) -> DataFrame:
    """What `read` makes of a folder with the rows' files, which go once it is written to the shared folder."""
    folder = new_folder(spark, "files")
    write_files(rows, folder)
    found = cut(read(folder))
    remove(spark, folder)
    return found


FOLDERS = 256  # over which files of one kind are dealt


@query(f"WITH {ENTRIES} SELECT * FROM declared")
def file_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as files: the root's own and those of the units, found by globs, named relative to the root."""
    rows = V.manifests(spark, sf_dir, root_parts=1).select(F.col("manifest").alias("path"), F.to_json(F.struct("dependencies", "devDependencies", "overrides", F.lit("x").alias("name"))).alias("body"))
    return from_files(spark, rows, lambda folder: D.declarations(D.all_declarations(files.read_manifests(spark, "package.json", "units/*/package.json", root=folder))))


#: Suppliers as release units, some of them faulty in every way that files can be.
UNITS = """
unit AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'system' ELSE 'curated' END AS tier, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS ordinal,
         CASE WHEN s_suppkey % 17 = 0 THEN 'U' ELSE 'u' END || s_suppkey AS name, s_suppkey % 19 = 0 AS bare, s_suppkey % 10 = 3 AS headless,
         CASE WHEN s_suppkey % 23 = 0 THEN 'dup' WHEN s_suppkey % 29 = 0 THEN 'x' || s_suppkey WHEN s_suppkey % 17 = 0 THEN 'U' || s_suppkey ELSE 'u' || s_suppkey END AS said,
         CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'unit ' || s_suppkey END AS described
  FROM supplier),
front AS (SELECT * FROM unit WHERE NOT bare AND NOT headless),
named AS (SELECT *, row_number() OVER (PARTITION BY said ORDER BY ordinal, name) AS place FROM front),
wrong AS (
  SELECT ordinal, name AS entry, 3 AS c, 'release unit has no UNIT.md: ' || name AS message FROM unit WHERE bare
  UNION ALL SELECT ordinal, name, 4, 'release unit has no README.md: ' || name FROM unit WHERE k % 7 = 0
  UNION ALL SELECT ordinal, name, 5, 'release unit has no unit.yaml: ' || name FROM unit WHERE k % 11 = 0
  UNION ALL SELECT ordinal, name, 6, 'descriptor has no usable frontmatter: ' || name FROM unit WHERE NOT bare AND headless
  UNION ALL SELECT ordinal, name, 7, 'descriptor has an invalid name: ' || name FROM front WHERE NOT regexp_full_match(said, '[a-z0-9]+(?:-[a-z0-9]+)*')
  UNION ALL SELECT ordinal, name, 8, 'descriptor has no description: ' || name FROM front WHERE described = ''
  UNION ALL SELECT ordinal, name, 9, 'descriptor name must equal its directory name: ' || name FROM front WHERE regexp_full_match(said, '[a-z0-9]+(?:-[a-z0-9]+)*') AND said <> name
  UNION ALL SELECT ordinal, name, 10, 'identity occurs more than once: ' || said FROM named WHERE place > 1
  UNION ALL SELECT ordinal, name, 12, 'release unit contains a nested unit: ' || name || '/sub/UNIT.md' FROM unit WHERE k % 13 = 0)
"""


def _unit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    each = lambda n: k % n == 0
    name = F.concat(F.when(each(17), "U").otherwise("u"), k)
    said = F.when(each(23), F.lit("dup")).when(each(29), F.concat(F.lit("x"), k)).otherwise(name)
    described = F.when(each(9), F.lit("''")).otherwise(F.concat(F.lit("unit "), k))
    head = F.when(k % 10 == 3, F.lit("no head\n")).otherwise(F.concat(F.lit("---\nname: "), said, F.lit("\ndescription: "), described, F.lit("\nrank: 012\n---\n# Unit\n")))
    file = lambda where, path, body: F.when(where, F.struct(F.lit(path).alias("path"), body.alias("body")))
    made = F.array(
        file(~each(19), "UNIT.md", head), file(~each(7), "README.md", F.lit("# Read\n")), file(~each(11), "unit.yaml", F.lit("a: 1\n")),
        file(each(13), "sub/UNIT.md", F.lit("x")), file(each(4), "dist/sub/UNIT.md", F.lit("x")), file(F.lit(True), "notes.txt", F.lit("x")),
    )
    tier = F.when(each(2), ".system/").otherwise(".curated/")
    units = table(spark, sf_dir, "supplier").select(tier.alias("tier"), name.alias("name"), F.explode(F.array_compact(made)).alias("f")).select(F.concat("tier", "name", F.lit("/"), "f.path").alias("path"), "f.body")
    extra = spark.createDataFrame([(".system/_assets/node_modules/a.txt", "x"), (".system/.hidden/UNIT.md", "x"), (".curated/loose.txt", "x")], "path string, body string")
    return units.unionByName(extra)


def _front(spark: SparkSession, folder: str) -> DataFrame:
    """tier, unit, name, description and error of the units' descriptors."""
    docs = files.read_documents(spark, f"{folder}/.*/*/UNIT.md")
    parts = F.split("path", "/")
    hidden = F.startswith(F.element_at(parts, -2), F.lit("."))
    return files.read_frontmatter(docs.filter(~hidden)).select(F.substring(F.element_at(parts, -3), 2, 99).alias("tier"), F.element_at(parts, -2).alias("unit"), "name", "description", "error")


def _found(spark: SparkSession, folder: str) -> DataFrame:
    tiers, entries = files.list_tiers(spark, _local(folder), LAYOUT.tiers)
    return validate.unit_violations(tiers, cut(entries), cut(_front(spark, folder)), LAYOUT)


@query(f"WITH {UNITS} SELECT 1 AS phase, ordinal AS tier_ordinal, entry, c AS check_ordinal, message FROM wrong")
def file_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers and units as folders: listing, required files, front matter, identities and nesting, everything that is wrong."""
    return from_files(spark, _unit_files(spark, sf_dir), lambda folder: _found(spark, folder))


@query(f"WITH {UNITS} SELECT 1 AS phase, ordinal AS tier_ordinal, entry, c AS check_ordinal, message FROM wrong ORDER BY ordinal, lower(entry), entry DESC, c, message LIMIT 1")
def file_first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of them in the order of checks, entries in locale order."""
    return from_files(spark, _unit_files(spark, sf_dir), lambda folder: validate.first_violation(_found(spark, folder)))


@query(f"WITH {UNITS} SELECT tier, name AS unit, row_number() OVER (PARTITION BY tier ORDER BY lower(name), name DESC) AS place FROM unit")
def file_unit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each tier in locale order, from a listing of folders."""

    def read(folder: str) -> DataFrame:
        _, entries = files.list_tiers(spark, _local(folder), LAYOUT.tiers)
        units = U.classify_entries(entries.filter(~F.contains("path", F.lit("/")))).filter("verdict = 'unit'")
        order = Window.partitionBy("tier").orderBy(F.collate("name", "UNICODE"), "name")
        return units.select("tier", F.col("name").alias("unit"), F.row_number().over(order).cast("long").alias("place"))

    return from_files(spark, _unit_files(spark, sf_dir), read)


@query(f"""
WITH {UNITS}
SELECT tier, name AS unit, CASE WHEN NOT headless THEN said END AS name, CASE WHEN NOT headless THEN described END AS description, CASE WHEN headless THEN 'no frontmatter' END AS error
FROM unit WHERE NOT bare
UNION ALL SELECT 'total', 'units', count(*)::VARCHAR, NULL, NULL FROM unit""")
def file_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of Markdown descriptors, and how many units the tiers hold in all."""

    def read(folder: str) -> DataFrame:
        text = lambda c: F.try_variant_get(c, "$", "string").alias(c)
        rows = _front(spark, folder).select("tier", "unit", text("name"), text("description"), "error")
        tiers, entries = files.list_tiers(spark, _local(folder), LAYOUT.tiers)
        units = U.classify_entries(entries.filter(~F.contains("path", F.lit("/")))).filter("verdict = 'unit'")
        none = F.lit(None).cast("string")
        total = U.tier_totals(tiers, units).filter("tier IS NULL").select(F.lit("total").alias("tier"), F.lit("units").alias("unit"), F.col("releaseUnitCount").cast("string").alias("name"), none.alias("description"), none.alias("error"))
        return rows.unionByName(total)

    return from_files(spark, _unit_files(spark, sf_dir), read)


def _source_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source.yaml with all domains, categories and assignments, as text."""
    joined = lambda lines, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, lines))), lambda x: x["line"]), "\n")
    category = V.categories(spark, sf_dir).select("domain_id", F.concat(F.lit("      "), "category_id", F.when(F.col("usable"), ": {label: no}").otherwise(": ~")).alias("line"))
    per = category.groupBy("domain_id").agg(joined(F.col("line"), F.col("domain_id")).alias("lines"))
    domains = per.select(F.col("domain_id"), F.concat(F.lit("  "), "domain_id", F.lit(":\n    label: on\n    categories:\n"), "lines").alias("line")).agg(joined(F.col("line"), F.col("domain_id")).alias("domains"))
    unit = F.concat(F.lit("  "), "unit_id", F.lit(": {domain: "), "domain_id", F.lit(", category: "), "category_id", F.lit("}"))
    assigned = V.assignments(spark, sf_dir).select("unit_id", unit.alias("line")).agg(joined(F.col("line"), F.col("unit_id")).alias("assigned"))
    head = "schema: weir/v1\nsourceId: here\nmanifestRevision: 012\ndomain:\n"
    return domains.join(assigned).select(F.lit("source.yaml").alias("path"), F.concat(F.lit(head), "domains", F.lit("\nassignments:\n"), "assigned", F.lit("\n")).alias("body"))


@query("SELECT lower(r_name) AS domain_id, replace(lower(n_name), '_', '-') AS category_id, n_nationkey % 9 <> 8 AS usable FROM nation JOIN region ON n_regionkey = r_regionkey")
def file_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains and categories of a YAML file."""
    return from_files(spark, _source_yaml(spark, sf_dir), lambda folder: X.flatten_domains(files.read_yaml(spark, f"{folder}/source.yaml")))


@query(f"""
WITH {TAXONOMY}, names AS (SELECT DISTINCT domain_id FROM category), line AS (SELECT DISTINCT unit_id FROM assignment), known AS (SELECT DISTINCT unit_id, domain_id, category_id FROM assignment WHERE domain_id IN (SELECT domain_id FROM names)),
bad AS (
  SELECT 'invalid domain id: ' || domain_id AS message, 2 AS c FROM names WHERE NOT regexp_full_match(domain_id, '[a-z0-9]+(?:-[a-z0-9]+)*')
  UNION ALL SELECT DISTINCT 'invalid category id: ' || category_id, 3 FROM category WHERE NOT regexp_full_match(category_id, '[a-z0-9]+(?:-[a-z0-9]+)*')
  UNION ALL SELECT 'invalid assigned id: ' || unit_id, 4 FROM line WHERE NOT regexp_full_match(unit_id, '[a-z0-9]+(?:-[a-z0-9]+)*')
  UNION ALL SELECT DISTINCT 'unknown domain of ' || unit_id, 6 FROM assignment WHERE domain_id NOT IN (SELECT domain_id FROM names)
  UNION ALL SELECT 'unknown category of ' || unit_id, 7 FROM known k WHERE NOT EXISTS (SELECT 1 FROM category c WHERE c.domain_id = k.domain_id AND c.category_id = k.category_id AND usable))
SELECT 'invalid source identity' AS message, 1 AS check_ordinal UNION ALL SELECT message, c FROM bad""")
def file_taxonomy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema, identity, ids, references and coverage of the YAML file; its sourceId is not the one asked for."""
    layout = validate.Layout(schema="weir/v1", identity={"sourceId": "there"})

    def read(folder: str) -> DataFrame:
        source = cut(files.read_yaml(spark, f"{folder}/source.yaml"))
        return validate.taxonomy_violations(source, V.assignments(spark, sf_dir).select("unit_id").distinct(), layout).select("message", "check_ordinal")

    return from_files(spark, _source_yaml(spark, sf_dir), read)


@query("""
SELECT 'part-' || p_partkey || ['.png', '.jpeg', '.zip'][p_partkey % 3 + 1] AS path, ['png', 'jpg', 'zip'][p_partkey % 3 + 1] AS claimed, ['png', 'jpg', 'pdf', 'gz'][p_partkey % 5 + 1] AS found
FROM part WHERE p_partkey % 5 < 4 AND ['png', 'jpg', 'zip'][p_partkey % 3 + 1] <> ['png', 'jpg', 'pdf', 'gz'][p_partkey % 5 + 1]""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose name claims another type than their first bytes."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    path = F.concat(F.lit("part-"), k, pick([".png", ".jpeg", ".zip"], 3))
    body = F.unhex(pick(["89504E470D0A1A0A00", "FFD8FFE000", "255044462D312E", "1F8B0800", "00"], 5))
    dealt = F.pmod(k, F.lit(FOLDERS)).cast("string")
    rows = table(spark, sf_dir, "part").select(dealt.alias("dealt"), F.concat_ws("/", dealt, path).alias("path"), body.alias("body"))

    def read(folder: str) -> DataFrame:
        return C.wrong_extensions(files.read_heads(spark, folder).withColumn("path", F.element_at(F.split("path", "/"), -1)))

    folder = new_folder(spark, "files")
    try:
        write_files(rows.repartition("dealt"), folder)
        return cut(read(folder))
    finally:
        files.remove_below(spark, folder)


@query("""
WITH place AS (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT 'r' || r_regionkey AS path, '1' AS node, NULL AS parent, 0 AS depth, r_name AS title FROM region
UNION ALL SELECT 'r' || n_regionkey, '1.' || i, '1', 1, n_name FROM place""")
def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines (a region with its nations) taken apart."""
    child = F.concat(F.lit("<outline text='"), "n_name", F.lit("'/>"))
    kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", child.alias("x")))), lambda y: y["x"]), "")
    per = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(kids.alias("kids"))
    region = table(spark, sf_dir, "region")
    docs = region.join(per, region["r_regionkey"] == per["n_regionkey"], "left")
    text = F.concat(F.lit("<opml><body><outline text='"), "r_name", F.lit("'>"), F.coalesce("kids", F.lit("")), F.lit("</outline></body></opml>"))
    return outlines.read_outlines(docs.select(F.concat(F.lit("r"), "r_regionkey").alias("path"), text.alias("text")))


@query("""
SELECT p_partkey AS doc_id, 0 AS position, p_name AS alt, p_type || '.png' AS target FROM (SELECT p_partkey, p_name, replace(p_type, ' ', '-') AS p_type FROM part)
UNION ALL SELECT p_partkey, 1, '', 'x' || p_partkey || '.jpg' FROM part""")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative texts and targets of Markdown images."""
    text = F.concat(F.lit("!["), "p_name", F.lit("]("), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit(".png) and ![](x"), "p_partkey", F.lit('.jpg "t")'))
    return C.captions(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query(f"""
WITH {ENTRIES}
SELECT DISTINCT name, CASE WHEN substr(name, 5)::BIGINT % 10 = 0 THEN 404 ELSE 200 END AS http_status,
       CASE WHEN substr(name, 5)::BIGINT % 10 > 1 THEN (substr(name, 5)::BIGINT % 7) || '.0.0' END AS version
FROM declared""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup a declared package by a bounded pool; the registry is a function here."""
    return registry.lookup_latest(D.declarations(D.all_declarations(V.manifests(spark, sf_dir))), "http://registry.invalid", _answer)


def _answer(url: str) -> tuple[int, str | None]:
    k = int(url.rsplit("/", 2)[1].split("-")[1])
    return (404, None) if k % 10 == 0 else (200, f"{k % 7}.0.0" if k % 10 > 1 else None)


@query(f"WITH {ENTRIES} SELECT CASE WHEN EXISTS (SELECT 1 FROM violation) THEN 1 ELSE 0 END AS status, 'Dependency currency audit passed: ' || (SELECT count(DISTINCT name) FROM declared) || ' declared packages across ' || (SELECT count(DISTINCT manifest) FROM entry WHERE manifest <> 'package.json') || ' manifests are current.' AS line")
def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit status of the audit, and the line that a clean one would print."""
    manifests = V.manifests(spark, sf_dir)
    found = audit.violations(manifests, V.latest(spark, sf_dir))
    line = audit.passed_line(D.declarations(D.all_declarations(manifests)), manifests)
    return spark.createDataFrame([(audit.exit_status(found), line)], "status int, line string")


BUILD = """buildable AS (SELECT tier, name FROM entry WHERE kind IN ('dir', 'dirlink') AND NOT starts_with(name, '.') AND NOT starts_with(name, '_'))"""


@query(f"""
WITH {ENTRY_SQL}, {BUILD}
SELECT row_number() OVER (ORDER BY tier, name) - 1 AS place, 'Built ' || name AS line FROM buildable
UNION ALL SELECT count(*), 'Built ' || count(*) || ' units' FROM buildable""")
def built_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a build: a line a unit, tier by tier, then how many."""
    tiers = table(spark, sf_dir, "events").select(F.col("event_type").alias("tier")).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("tier")))  # a row a tier
    return U.built(U.buildable(V.entries(spark, sf_dir)), tiers)


@query("""
WITH have AS (SELECT DISTINCT o_custkey AS unit, o_orderpriority AS feature FROM orders), units AS (SELECT DISTINCT unit FROM have), features AS (SELECT feature, count(*) AS n_with FROM have GROUP BY 1)
SELECT feature, n_with, count(*) AS n_without, string_agg(unit, ',' ORDER BY unit) AS without
FROM features, units WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.unit = units.unit AND h.feature = features.feature) GROUP BY 1, 2""")
def unit_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that some units have and others lack: customers and the priorities of their orders."""
    found = U.parity(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    return found.withColumn("without", F.array_join(F.transform("without", lambda x: x.cast("string")), ","))


@query(f"""
SELECT doc_id, i - 1 AS position, section
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS section, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
WHERE length(trim(section)) > 0 AND list_has_any(regexp_extract_all(lower(section), '[a-z]+'), {list(TERMS)})""")
def search_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that have one of the terms."""
    return S.filter_sections(S.sections(table(spark, sf_dir, "documents")), TERMS)


@query(f"""
WITH low AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents),
hit AS (SELECT doc_id, t, coalesce(list_min(list_filter([{', '.join(f"strpos(l, '{t}')" for t in TERMS)}], lambda x: x > 0)), 1) AS p FROM low)
SELECT doc_id, substr(t, p, 80) AS snippet FROM hit""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snippets(table(spark, sf_dir, "documents").select("doc_id", "text"), TERMS).select("doc_id", "snippet")


@query(f"""
WITH t AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
pair AS (SELECT toks[i] AS a, toks[i + 1] AS b FROM t, generate_series(1, len(toks) - 1) s(i))
SELECT least(a, b) AS source, greatest(a, b) AS target, count(*) AS weight FROM pair WHERE a <> b GROUP BY 1, 2""")
def term_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms stand side by side, and how often."""
    return S.edges(table(spark, sf_dir, "documents"))


@query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index fed by two batches, compacted, and fed once more: older versions give way."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_folder(spark, "index")
    old = docs.filter("doc_id % 3 <> 0").withColumn("text", F.concat_ws(" ", F.lit("stale"), "text"))
    twice = old.withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(0)).withColumn("text", F.lit("older")))
    incremental.upsert(twice, 0, f"{folder}/a", order_col="n")
    incremental.upsert(docs.filter("doc_id % 2 = 0"), 1, f"{folder}/a")
    incremental.compact(spark, f"{folder}/a", f"{folder}/b", 4)
    incremental.clear(spark, f"{folder}/a")
    incremental.upsert(docs, 0, f"{folder}/b")
    found = cut(incremental.read_index(spark, f"{folder}/b"))
    remove(spark, folder)
    return found


@query("""
WITH RECURSIVE org(node, parent, depth, path) AS (
  SELECT c_custkey, NULL::BIGINT, 0, c_custkey::VARCHAR FROM customer WHERE c_custkey = 0
  UNION ALL
  SELECT c_custkey, org.node, depth + 1, path || '/' || c_custkey FROM customer JOIN org ON c_custkey > 0 AND c_custkey - least(c_custkey, 1 + c_custkey % 7) = org.node)
SELECT node, coalesce(parent, -1) AS parent, depth, path FROM org""")
def org_chart_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep hierarchy (hundreds of levels) read from CSV files."""
    folder = new_folder(spark, "csv")
    table(spark, sf_dir, "customer").selectExpr("c_custkey AS node", "if(c_custkey = 0, NULL, c_custkey - least(c_custkey, 1 + c_custkey % 7)) AS parent").write.csv(folder, header=True)
    found = C.hierarchy(C.read_edges(spark, folder, node="node long", parent="parent long"))  # what it reads is cut
    remove(spark, folder)
    return found.withColumn("parent", F.coalesce("parent", F.lit(-1)).cast("long"))


