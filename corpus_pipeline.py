"""From raw documents to token digests: five stages, each written as Parquet and read again.

Defined cases, for every stage: null and empty texts have no tokens, words or shingles (toxicity
keeps them, quality rejects them, near duplicates leave each alone, mixing gives a source of nothing
else the rate 0, tokens gives no ids). A null language or source is one of its own. Rows without an
id all pass near duplicates; rows that repeat an id and its text count there as one, and are treated
alike elsewhere. Texts are taken whole. An empty table gives an empty table. Extra columns stay,
whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirwork.llm.bpe import encode_digests
from weirwork.llm.common import cut, new_folder, remove, table
from weirwork.llm.mixing import mix_sources
from weirwork.llm.ngram_join import one_per_component
from weirwork.llm.quality import keep_quality
from weirwork.llm.queries import tokenizer_file
from weirwork.llm.toxicity import drop_toxic, train

ORACLE_SQL = None  # a fitted field and tokenisers are not SQL; tests compare with plain versions


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores as toxic go; it learns from the raw documents' labels."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drop_toxic(docs, model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    return keep_quality(docs, tokenizer_file("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at Jaccard 0.8 or more stays."""
    return one_per_component(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards equal shares of characters and shuffled."""
    return mix_sources(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every row's ids and of what they decode to."""
    return encode_digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = new_folder(spark, "pipeline"), None
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before is not None:
                remove(spark, f"{folder}/{before}")
            before = name
        return cut(docs)  # a checkpoint, which Spark removes with the result where it is told to
    finally:
        remove(spark, folder)
