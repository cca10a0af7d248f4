"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .bpe import encode_digests
from .collocations import collocations
from .common import cut, new_folder, remove, table
from .ego_join import near_duplicates
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .ppm import ppm_scores
from .quality import quality_rules
from .sharding import minimax_shards
from .toxicity import tag_toxicity, train
from .transcripts import held_out, parse_transcripts, raw_transcripts
from .transcripts import train as train_roles
from .url_rules import judge_urls
from .wavelet import read_shards, write_shards


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "copy_no", "n_copies", F.round("mix_rate", 9).alias("mix_rate"), "shuffle_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP1_SQL = """
WITH size AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source),
total AS (SELECT sum(chars) AS chars, count(*)::DOUBLE AS n FROM size),
rate AS (
  SELECT source, CASE WHEN s.chars > 0 THEN t.chars * 1.0::DOUBLE / t.n / s.chars ELSE 0 END AS mix_rate
  FROM size s, total t),
part AS (SELECT source, mix_rate, greatest(1, ceil(mix_rate / 16.0::DOUBLE))::INT AS parts FROM rate),
mean AS (SELECT *, mix_rate / parts AS m FROM part),
term AS (
  SELECT source, k, exp(k * ln(greatest(m, 1e-300::DOUBLE)) - m - lgamma(k + 1.0::DOUBLE)) AS p FROM mean, generate_series(0, 80) g(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM term),
draw AS (
  SELECT d.doc_id, d.source, d.lang, d.text, m.mix_rate,
         ('0x' || substr(md5('20240601|' || d.doc_id || '|' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents d JOIN mean m ON d.source IS NOT DISTINCT FROM m.source, generate_series(0, m.parts - 1) s(i)),
drawn AS (SELECT *, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draw.source AND cdf.c <= draw.u) AS n FROM draw),
counted AS (
  SELECT doc_id, source, lang, md5(coalesce(text, '')) AS text_md5, any_value(mix_rate) AS mix_rate, sum(n)::INT AS n_copies
  FROM drawn GROUP BY doc_id, source, lang, text)
SELECT doc_id, source, lang, j::INT AS copy_no, n_copies, round(mix_rate, 9) AS mix_rate,
       ('0x' || substr(md5('20240602|' || doc_id || '|' || j), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shuffle_key, text_md5
FROM counted, generate_series(0, n_copies - 1) s(j)
"""


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of urls: those of the document that the page shows (its doc_id is the last part of the path; the languages agree)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", r"://[^?#]*/([0-9]{1,18})(?:[./][^/?#]*)?(?:[?#].*)?\z", 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    labelled = pages.select("url", number.alias("number")).join(labels, "number").select("url", "blocked")
    return judge_urls(pages, labelled).withColumn("mined_confidence", F.round("mined_confidence", 6))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "wavelet")
    try:
        manifest = write_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), folder)
        return cut(read_shards(manifest, folder))
    finally:
        remove(spark, folder)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = tag_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return tagged.select("doc_id", "held_out", "score", "predicted", "spans")


def op3_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE vec AS (
  SELECT vec_id, embedding::DOUBLE[] AS v,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vec x JOIN vec y ON x.vec_id <> y.vec_id AND x.ok AND y.ok
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95::DOUBLE),
reach(s, t) AS (SELECT vec_id, vec_id FROM vec UNION SELECT reach.s, link.b FROM reach JOIN link ON reach.t = link.a),
comp AS (SELECT s AS vec_id, min(t) AS component_id FROM reach GROUP BY s),
deg AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN deg USING (vec_id)
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
worded AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered),
gram AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
  FROM worded, generate_series(1, greatest(len(w) - 3, 1)) s(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(s, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.s, both_ways.b FROM reach JOIN both_ways ON reach.t = both_ways.a)
SELECT doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(t) AS component_id
FROM reach JOIN documents ON s = doc_id LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_transcripts(table(spark, sf_dir, "conversations"))
    turns = parse_transcripts(lines, train_roles(lines))
    return turns.select("conv_id", "turn", held_out(F.col("conv_id")).alias("held_out"), "role", F.length("text").alias("n_chars"), F.md5(F.col("canonical").cast("binary")).alias("canonical_md5"))


def op11_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, k, w[i:i+k-1] AS g FROM worded, generate_series(1, 3) a(k), generate_series(1, 1000000) b(i)
  WHERE i <= len(w) - k + 1),
f AS (SELECT lang, k, g, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, j, x.f AS l, y.f AS r, (c.a::HUGEINT * c.a * 1000000) // (x.f::HUGEINT * y.f) AS score
  FROM candidate c, generate_series(1, 2) s(j) JOIN f x ON x.lang = c.lang AND x.k = j AND x.g = c.g[1:j] JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.g = c.g[j+1:c.k]
  WHERE j < c.k),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
covered AS (
  SELECT DISTINCT s.lang, s.g FROM candidate s JOIN candidate t ON s.lang = t.lang AND s.k = 2 AND t.k = 3 AND (t.g[1:2] = s.g OR t.g[2:3] = s.g)
  WHERE 100 * t.a >= 50 * s.a),
kept AS (SELECT * FROM scored ANTI JOIN covered USING (lang, g)),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score
  FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_ego_join": op3_ego_join,
    "op4_quality": op4_quality,
    "op5_url_rules": op5_url_rules,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_wavelet": op8_wavelet,
    "op9_transcripts": op9_transcripts,
    "op10_ngram_join": op10_ngram_join,
    "op11_ppm": op11_ppm,
    "op12_alignment": op12_alignment,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op3_ego_join": OP3_SQL,
    "op10_ngram_join": OP10_SQL,
    "op13_collocations": OP13_SQL,
}
