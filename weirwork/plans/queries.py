"""The registered queries of the catalogue and document operators, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare as C
from ..operators import dependencies as D
from ..operators import search as S
from ..operators import taxonomy as X
from ..operators import units as U
from . import audit, validate
from . import tables as V
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ("rewh", "ononst", "thth")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


ENTRIES = """
entry AS (
  SELECT CASE WHEN l_suppkey % 50 = 0 THEN 'package.json' ELSE 'units/u' || l_suppkey || '/package.json' END AS manifest,
         ['dependencies', 'devDependencies', 'overrides'][l_linenumber % 3 + 1] AS section, 'pkg-' || l_partkey AS name,
         min(CASE l_returnflag WHEN 'R' THEN '~' WHEN 'A' THEN '' ELSE '^' END || l_linenumber || '.' || (l_quantity::INT % 2) || '.0') AS spec
  FROM lineitem GROUP BY 1, 2, 3),
raw AS (SELECT manifest, name, spec FROM entry WHERE manifest = 'package.json' OR section = 'dependencies'),
declared AS (
  SELECT manifest, name, spec, CASE WHEN starts_with(spec, '^') THEN substr(spec, 2) ELSE spec END AS version
  FROM raw WHERE regexp_full_match(spec, '\\^?[0-9]+[.][0-9]+[.][0-9]+')),
latest AS (
  SELECT 'pkg-' || p_partkey AS name, CASE WHEN p_size % 10 = 0 THEN 404 ELSE 200 END AS http_status,
         CASE WHEN p_size % 10 = 1 THEN NULL ELSE (p_size % 7 + 1) || '.' || (p_size % 2) || '.0' END AS version
  FROM part),
unsupported AS (
  SELECT manifest || ': ' || name || ' has unsupported dependency spec ' || spec AS message, manifest, name, spec
  FROM raw WHERE NOT regexp_full_match(spec, '\\^?[0-9]+[.][0-9]+[.][0-9]+')),
per_spec AS (SELECT name, spec, string_agg(manifest, ', ' ORDER BY manifest) AS manifests FROM declared WHERE manifest <> 'package.json' GROUP BY 1, 2),
drift AS (
  SELECT name, count(*) AS n_specs, 'shared dependency drift for ' || name || ': ' || string_agg(spec || ' in ' || manifests, '; ' ORDER BY spec || ' in ' || manifests) AS message
  FROM per_spec GROUP BY name HAVING count(*) >= 2),
found AS (
  SELECT n.name, coalesce(l.http_status, 404) AS http_status, l.version AS latest
  FROM (SELECT DISTINCT name FROM declared) n LEFT JOIN latest l ON n.name = l.name),
currency AS (
  SELECT name, 'lookup' AS kind, name || ': registry lookup failed with HTTP ' || http_status AS message FROM found WHERE http_status NOT BETWEEN 200 AND 299
  UNION ALL
  SELECT name, 'no_version', name || ': registry response has no latest version' FROM found WHERE http_status BETWEEN 200 AND 299 AND latest IS NULL
  UNION ALL
  SELECT d.name, 'outdated', manifest || ': ' || d.name || ' declares ' || version || '; npm latest is ' || latest
  FROM declared d JOIN found f ON d.name = f.name WHERE http_status BETWEEN 200 AND 299 AND version <> latest),
violation AS (
  SELECT 'unsupported' AS kind, message FROM unsupported UNION ALL SELECT 'drift', message FROM drift UNION ALL SELECT kind, message FROM currency)
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.all_declarations(V.manifests(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT * FROM declared")
def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, entries, versions of all manifests."""
    return D.declarations(_rows(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT manifest, name, spec, message FROM unsupported")
def unsupported_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unsupported(_rows(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT name, n_specs, message FROM drift")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.drift(D.declarations(_rows(spark, sf_dir)))


@query(f"WITH {ENTRIES} SELECT name, count(*) AS n, string_agg(manifest || ' ' || spec || ' ' || version, '; ' ORDER BY manifest, spec, version) AS declarations FROM declared GROUP BY name")
def declarations_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.by_name(D.declarations(_rows(spark, sf_dir)))
    text = F.array_join(F.transform("declarations", lambda d: F.concat_ws(" ", d["manifest"], d["spec"], d["version"])), "; ")
    return found.select("name", F.size("declarations").cast("long").alias("n"), text.alias("declarations"))


@query(f"WITH {ENTRIES} SELECT (SELECT count(DISTINCT name) FROM declared) AS n_packages, (SELECT count(DISTINCT manifest) FROM entry WHERE manifest <> 'package.json') AS n_manifests")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.manifests(spark, sf_dir)
    return D.audit_counts(D.declarations(D.all_declarations(found)), found)


@query(f"WITH {ENTRIES} SELECT name, kind, message FROM currency")
def currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.currency(D.declarations(_rows(spark, sf_dir)), V.latest(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT 'Dependency currency violation: ' || message AS line FROM violation ORDER BY line")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit, sorted."""
    return audit.report(audit.violations(V.manifests(spark, sf_dir), V.latest(spark, sf_dir)))


@query(f"WITH {ENTRIES} SELECT kind, count(*) AS n, min(message) AS first FROM violation GROUP BY kind")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.violations(V.manifests(spark, sf_dir), V.latest(spark, sf_dir))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.min("message").alias("first"))


COVERAGE = """
SELECT 'missing' AS kind, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'unknown', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(COVERAGE)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels and labels without documents."""
    return _coverage(spark, sf_dir)


@query(f"""
WITH c AS ({COVERAGE})
SELECT 'Source taxonomy coverage mismatch. Missing: ' || coalesce(string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id::VARCHAR) FILTER (kind = 'missing'), 'none')
       || '. Unknown: ' || coalesce(string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id::VARCHAR) FILTER (kind = 'unknown'), 'none') || '.' AS message, count(*) AS n
FROM c""")
def coverage_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.coverage_message(_coverage(spark, sf_dir), "doc_id")


TAXONOMY = """
category AS (SELECT lower(r_name) AS domain_id, replace(lower(n_name), '_', '-') AS category_id, n_nationkey % 9 <> 8 AS usable FROM nation JOIN region ON n_regionkey = r_regionkey),
assignment AS (
  SELECT lower(replace(s_name, '#', '-')) AS unit_id,
         CASE WHEN s_suppkey % 7 = 0 THEN 'nowhere' WHEN s_suppkey % 5 = 0 THEN 'asia' ELSE lower(r_name) END AS domain_id, replace(lower(n_name), '_', '-') AS category_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query("SELECT lower(r_name) AS domain_id, replace(lower(n_name), '_', '-') AS category_id, n_nationkey % 9 <> 8 AS usable FROM nation JOIN region ON n_regionkey = r_regionkey")
def taxonomy_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested maps of domains and categories, built as one VARIANT document and taken apart again."""
    value = F.when(F.col("usable"), F.lit("x"))
    nested = V.categories(spark, sf_dir).groupBy("domain_id").agg(F.map_from_entries(F.collect_list(F.struct("category_id", value))).alias("categories"))
    source = nested.agg(F.parse_json(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("domain_id", F.struct("categories")))).alias("domain")), {"ignoreNullFields": "false"})).alias("document"))
    return X.flatten_domains(source)


@query(f"WITH {TAXONOMY} SELECT unit_id, domain_id, category_id FROM assignment WHERE domain_id NOT IN (SELECT domain_id FROM category)")
def unknown_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.unknown_domains(V.assignments(spark, sf_dir), V.categories(spark, sf_dir)).select("unit_id", "domain_id", "category_id")


@query(f"WITH {TAXONOMY} SELECT unit_id, domain_id, category_id FROM assignment a WHERE NOT EXISTS (SELECT 1 FROM category c WHERE c.domain_id = a.domain_id AND c.category_id = a.category_id AND usable)")
def unknown_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.unknown_categories(V.assignments(spark, sf_dir), V.categories(spark, sf_dir)).select("unit_id", "domain_id", "category_id")


NAMES = "SELECT lower(r_name) AS name FROM region UNION SELECT replace(lower(n_name), '_', '-') FROM nation UNION SELECT c_name FROM customer UNION SELECT lower(p_type) FROM part UNION SELECT p_name FROM part"


@query(f"WITH n AS ({NAMES}) SELECT name FROM n WHERE NOT regexp_full_match(name, '[a-z0-9]+(?:-[a-z0-9]+)*')")
def invalid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, e: table(spark, sf_dir, n).select(F.expr(e).alias("name"))
    names = t("region", "lower(r_name)").union(t("nation", "replace(lower(n_name), '_', '-')")).union(t("customer", "c_name")).union(t("part", "lower(p_type)")).union(t("part", "p_name"))
    return X.invalid_identifiers(names, "name")


@query("""
WITH t AS (SELECT DISTINCT c_mktsegment AS tier, true AS present FROM customer UNION ALL SELECT 'ABSENT', false),
u AS (SELECT t.tier, present, count(c_custkey) AS n FROM t LEFT JOIN customer ON c_mktsegment = t.tier GROUP BY 1, 2)
SELECT tier, bool_or(present) AS present, sum(n)::BIGINT AS "releaseUnitCount" FROM u GROUP BY ROLLUP (tier)""")
def tier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per tier and in all; tiers without units stay."""
    return U.tier_totals(V.tiers(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tier")))


@query("SELECT md5(text) AS name, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.duplicates(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("name")))


LISTING = """
listed AS (SELECT 'u' || o_custkey AS unit, 'u' || o_custkey || '/' || ['UNIT.md', 'README.md', 'unit.yaml', 'sub/UNIT.md', 'dist/UNIT.md', 'notes.txt'][o_orderkey % 6 + 1] AS path FROM orders)
"""


@query(f"""
WITH {LISTING}
SELECT unit, file FROM (SELECT DISTINCT unit FROM listed), (VALUES ('UNIT.md'), ('README.md'), ('unit.yaml')) f(file)
EXCEPT SELECT unit, substr(path, length(unit) + 2) FROM listed""")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.listing(spark, sf_dir)
    return U.missing_files(found.select("unit").distinct(), found, V.REQUIRED)


@query(f"""
WITH {LISTING}
SELECT DISTINCT unit, substr(path, 1, length(path) - 8) AS nested FROM listed WHERE path = unit || '/sub/UNIT.md'""")
def nested_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.listing(spark, sf_dir)
    tail = "/" + V.DESCRIPTOR
    markers = found.filter(F.endswith("path", F.lit(tail))).select(F.expr(f"substring(path, 1, length(path) - {len(tail)})").alias("path")).distinct()
    return U.nested_units(found.select("unit").distinct(), markers, V.PRUNED)


ENTRY_SQL = """
entry AS (
  SELECT event_type AS tier, ['.hidden-' || event_id, '_assets', '_other-' || event_id, 'unit-' || user_id, 'Unit-' || event_id][event_id % 5 + 1] AS name,
         ['dir', 'link', 'file', 'other'][event_id % 4 + 1] AS kind
  FROM events)
"""


@query(f"""
WITH {ENTRY_SQL}
SELECT tier, name, kind, CASE WHEN starts_with(name, '.') THEN 'skip' WHEN kind = 'link' THEN 'link' WHEN kind <> 'dir' THEN 'not_dir' WHEN name = '_assets' THEN 'shared' ELSE 'unit' END AS verdict
FROM entry""")
def classified_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.classify_entries(V.entries(spark, sf_dir)).select("tier", "name", "kind", "verdict")


@query(f"WITH {ENTRY_SQL} SELECT tier, name, tier || '/' || name AS path FROM entry WHERE kind = 'dir' AND name NOT LIKE '.%' AND NOT starts_with(name, '_')")
def buildable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.buildable(V.entries(spark, sf_dir))


@query(f"WITH {ENTRY_SQL} SELECT tier, name, kind FROM entry WHERE name = '_assets' AND kind NOT IN ('file', 'dir')")
def irregular_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.irregular(V.entries(spark, sf_dir).filter(F.col("name") == U.SHARED)).select("tier", "name", "kind")


@query("""
SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
       (json_extract(props, '$.k'))::BIGINT AS k, json_type(props, '$.k') = 'VARCHAR' AS k_is_string, '{"event_id":' || event_id || ',"type":"' || event_type || '"}' AS again
FROM events""")
def dynamic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type guards on dynamic JSON values, parsing and serialising."""
    value = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select(
        "event_id", T.variant_kind(value).alias("kind"), F.try_variant_get(value, "$.k", "bigint").alias("k"),
        T.is_string(F.try_variant_get(value, "$.k", "variant")).alias("k_is_string"), F.to_json(F.struct("event_id", F.col("event_type").alias("type"))).alias("again"),
    )


@query(r"""
SELECT page_id, regexp_extract(url, '[^/]*$') AS base, 'a/b/' || regexp_extract(url, '[^/]*$') AS joined,
       regexp_matches(url, '\.html') AS html, ends_with(url, '.md') AS markdown, length(url) > 0 AS filled,
       replace(replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS encoded
FROM pages""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.basename(url).alias("base"), T.join_path(F.lit("a"), F.lit("b"), T.basename(url)).alias("joined"), url.rlike(r"\.html").alias("html"),
        T.is_markdown(url).alias("markdown"), T.filled(url).alias("filled"), T.encode_component(url).alias("encoded"),
    )


@query(f"WITH {ENTRIES} SELECT kind, message FROM violation ORDER BY CASE kind WHEN 'unsupported' THEN 1 WHEN 'drift' THEN 2 ELSE 3 END, message LIMIT 1")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first problem in the order of checks, by one minimum instead of a global sort."""
    found = audit.violations(V.manifests(spark, sf_dir), V.latest(spark, sf_dir))
    phase = F.when(F.col("kind") == "unsupported", 1).when(F.col("kind") == "drift", 2).otherwise(3)
    placed = found.select(phase.alias("phase"), F.lit(0).alias("tier_ordinal"), F.lit("").alias("entry"), F.lit(0).alias("check_ordinal"), F.concat_ws("\x01", "message", "kind").alias("message"))
    parts = F.split("message", "\x01")
    return validate.first_violation(placed).select(parts[1].alias("kind"), parts[0].alias("message"))


@query("""
WITH t AS (SELECT DISTINCT c_mktsegment AS tier, true AS present FROM customer UNION ALL SELECT 'ABSENT', false)
SELECT tier, present, count(c_custkey) AS n, sum(count(c_custkey)) OVER ()::BIGINT AS total FROM t LEFT JOIN customer ON c_mktsegment = t.tier GROUP BY 1, 2""")
def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indented JSON summary, written and read back."""
    tiers = V.tiers(spark, sf_dir)
    totals = U.tier_totals(tiers, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tier")))
    ordered = tiers.withColumn("ordinal", F.crc32(F.col("tier").cast("binary")))
    text = validate.json_summary(totals, ordered)
    back = text.select(F.from_json("summary", "roots array<struct<tier:string,present:boolean,releaseUnitCount:long>>, totals struct<releaseUnitCount:long>").alias("s"))
    return back.select(F.explode("s.roots").alias("r"), F.col("s.totals.releaseUnitCount").alias("total")).select("r.tier", "r.present", F.col("r.releaseUnitCount").alias("n"), "total")


TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
BM25 = f"""
tok AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
cnt AS (SELECT doc_id, len(toks) AS n_tokens, {', '.join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf_{i}" for i, t in enumerate(TERMS))} FROM tok),
stat AS (SELECT count(*) AS n, avg(n_tokens) AS mean, {', '.join(f'count(*) FILTER (tf_{i} > 0) AS df_{i}' for i in range(len(TERMS)))} FROM cnt),
lexical AS (
  SELECT doc_id, round({' + '.join(f'CASE WHEN tf_{i} > 0 THEN ln(1 + (n - df_{i} + 0.5::DOUBLE) / (df_{i} + 0.5::DOUBLE)) * tf_{i} * 2.2::DOUBLE / (tf_{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / mean)) ELSE 0 END' for i in range(len(TERMS)))}, 6) AS score
  FROM cnt, stat WHERE {' OR '.join(f'tf_{i} > 0' for i in range(len(TERMS)))})
"""


@query(f"WITH {BM25} SELECT doc_id, score FROM lexical ORDER BY score DESC, doc_id LIMIT 10")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten documents by BM25 (top-k is the feature)."""
    return S.top(S.bm25(table(spark, sf_dir, "documents"), TERMS), 10)


@query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(table(spark, sf_dir, "documents"))


@query("""
WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM vec q, vec d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 3""")
def search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of every vector whose id is divisible by 20, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return S.nearest(vectors.filter(F.col("vec_id") % 20 == 0), vectors, 3)


@query(f"""
WITH {BM25}, vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
semantic AS (SELECT d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS sem FROM vec q, vec d WHERE q.vec_id = 0),
scaled AS (SELECT doc_id, score / (SELECT max(score) FROM lexical) AS lex FROM lexical)
SELECT doc_id, round(0.5::DOUBLE * coalesce(sem, 0) + 0.5::DOUBLE * coalesce(lex, 0), 6) AS score
FROM semantic FULL OUTER JOIN scaled USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""")
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten of lexical and vector scores in equal parts; vector ids are taken as document ids."""
    vectors = table(spark, sf_dir, "embeddings")
    near = vectors.filter("vec_id = 0").select(F.col("embedding").alias("query"))
    semantic = vectors.join(F.broadcast(near)).select(F.col("vec_id").alias("doc_id"), F.round(S.cosine(F.col("embedding"), F.col("query")), S.DIGITS).alias("score"))
    return S.search(S.bm25(table(spark, sf_dir, "documents"), TERMS), semantic, 10)


@query("""
SELECT doc_id, i - 1 AS position, section
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS section, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
WHERE length(trim(section)) > 0""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections(table(spark, sf_dir, "documents"))


@query(r"""
SELECT page_id, i - 1 AS position, href
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) AS i FROM pages)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.links(table(spark, sf_dir, "pages"))


@query("""
WITH t AS (SELECT conv_id || '/' || (turn // 2) AS path, turn % 2 AS side, md5(string_agg(coalesce(text, ''), chr(1) ORDER BY turn, text)) AS digest FROM conversations GROUP BY 1, 2),
l AS (SELECT path, digest FROM t WHERE side = 0), r AS (SELECT path, digest FROM t WHERE side = 1)
SELECT path, CASE WHEN l.digest IS NULL THEN 'added' WHEN r.digest IS NULL THEN 'removed' WHEN l.digest = r.digest THEN 'same' ELSE 'changed' END AS status
FROM l FULL OUTER JOIN r USING (path)""")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings compared: of all turns the even and the odd ones stand for the files of two trees."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", F.expr("turn div 2")).alias("path"), (F.col("turn") % 2).alias("side"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    texts = turns.groupBy("path", "side").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    files = texts.select("path", "side", F.md5(F.array_join("x.text", "\x01").cast("binary")).alias("digest"))
    return C.diff_trees(*(files.filter(F.col("side") == k).drop("side") for k in (0, 1)))


@query("SELECT p_partkey AS name, CASE WHEN p_name = p_type THEN 'same' ELSE 'changed' END AS status, levenshtein(p_name, p_type) AS distance FROM part")
def text_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return C.compare_texts(part.select(F.col("p_partkey").alias("name"), F.col("p_name").alias("text")), part.select(F.col("p_partkey").alias("name"), F.col("p_type").alias("text"))).withColumn("distance", F.col("distance").cast("long"))


@query("""
WITH RECURSIVE org(node, parent, depth, path) AS (
  SELECT c_custkey, NULL::BIGINT, 0, c_custkey::VARCHAR FROM customer WHERE c_custkey = 0
  UNION ALL
  SELECT c_custkey, org.node, depth + 1, path || '/' || c_custkey FROM customer JOIN org ON c_custkey > 0 AND (c_custkey - 1) // 8 = org.node)
SELECT node, coalesce(parent, -1) AS parent, depth, path FROM org""")
def org_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy followed level by level: every customer reports to another."""
    edges = table(spark, sf_dir, "customer").selectExpr("c_custkey AS node", "if(c_custkey = 0, NULL, (c_custkey - 1) div 8) AS parent")
    return C.hierarchy(edges).withColumn("parent", F.coalesce("parent", F.lit(-1)).cast("long"))
