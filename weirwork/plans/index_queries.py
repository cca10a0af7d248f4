"""Queries that write an index of the documents into the shared folder, search it there and remove it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import block_index as X
from ..operators import vector_index as V
from ..sources.scratch import cut, new_folder, remove
from ..streaming.snapshots import Snapshots
from .queries import BM25, TERMS, TOKENS, query
from .tables import table

PHRASE = ("et", "la")


def _indexed(spark: SparkSession, sf_dir: str, ask: Callable[[Snapshots, DataFrame], DataFrame]) -> DataFrame:
    folder = new_folder(spark, "index")
    try:
        store = Snapshots(spark, folder)
        docs = table(spark, sf_dir, "documents")
        store.commit(docs)
        return cut(ask(store, docs))
    finally:
        remove(spark, folder)


@query(f"WITH {BM25} SELECT doc_id, score FROM lexical ORDER BY score DESC, doc_id LIMIT 10")
def index_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top ten of search_bm25, from the stored index: only the terms' own blocks, and of these only ranges that can matter."""
    return _indexed(spark, sf_dir, lambda store, _: store.open().ranked(TERMS, 10))


@query(f"""
WITH tok AS (SELECT doc_id, {TOKENS} AS t FROM documents),
hit AS (SELECT doc_id, list_filter(generate_series(1, len(t) - 1), lambda i: t[i] = '{PHRASE[0]}' AND t[i + 1] = '{PHRASE[1]}') AS h, t FROM tok)
SELECT doc_id, len(h)::BIGINT AS n_matches, h[1] - 1 AS first, array_to_string(t[greatest(h[1] - 4, 1):h[1] + 5], ' ') AS snippet FROM hit WHERE len(h) > 0""")
def index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a phrase of two words, how often, where first, and the tokens around it."""
    return _indexed(spark, sf_dir, lambda store, docs: X.snippets(store.open().matches(PHRASE), docs, 2))


TOXIC, POOR = "SELECT doc_id FROM labels WHERE toxic = 1", "SELECT doc_id FROM labels WHERE quality = 0"


@query(f"""
WITH now AS (
  SELECT doc_id, CASE WHEN doc_id IN ({POOR}) THEN coalesce(text, '') || ' revised text' ELSE text END AS text FROM documents WHERE doc_id NOT IN ({TOXIC})),
tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM now),
per AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL)
SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences, sum(tf * (doc_id % 1000003))::BIGINT AS digest FROM per GROUP BY term""")
def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds after documents of poor quality are changed, toxic ones deleted, and its segments merged."""

    def ask(store: Snapshots, docs: DataFrame) -> DataFrame:
        labels = table(spark, sf_dir, "labels")
        revised = docs.join(labels.filter("quality = 0").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" revised text")))
        store.commit(revised)
        store.commit(None, labels.filter("toxic = 1"))
        store.merge(every=True)
        index = store.open()
        names = index.ranges.select("range", F.posexplode("ids").alias("ords", "doc_id"))
        flat = index.blocks.select("term", "range", F.inline(F.arrays_zip("ords", "tfs"))).join(names, ["range", "ords"])
        tf = F.col("tfs").cast("long")
        return flat.groupBy("term").agg(F.count("*").alias("documents"), F.sum(tf).alias("occurrences"), F.sum(tf * (F.col("doc_id") % 1000003)).alias("digest"))

    return _indexed(spark, sf_dir, ask)


@query()
def index_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors, by the inverted file, of every vector whose id is divisible by 20, against all vectors. Tests measure the recall against search_nearest's way."""
    folder = new_folder(spark, "vectors")
    try:
        vectors = table(spark, sf_dir, "embeddings")
        V.build(vectors, folder)
        return cut(V.search(spark, folder, vectors.filter(F.col("vec_id") % 20 == 0), 10))
    finally:
        remove(spark, folder)
