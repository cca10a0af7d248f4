"""An inverted index that grows by micro-batches: only documents whose version is new are indexed.

An index folder holds `words`, a row for each document with its distinct terms and their counts, and the
much smaller `versions` (doc_id, version, batch), a part for each batch of the one stream that feeds it.
A batch counts once its versions are written, after its words; writing it again changes nothing.
Compaction turns words into `postings`, a row for each term and document, and keeps versions, as of a
batch before all others, so a new stream may go on from a compacted index.

Documents are counted one by one and stay packed until the live ones are known: a row for each term of
a document takes several times the text's room, and so is shuffled by compaction and after it only.

Defined cases: of several rows of one document in a batch the last by the order column counts, and
without one, or in ties, that of the greatest text. A null text is an empty one; a document without
terms has a version and no postings, and its older postings give way. Rows without an id are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import tokens

POSTINGS = "term string, doc_id long, tf long, batch long"
WORDS = "doc_id long, version string, batch long, n int, terms string, tfs string"
VERSIONS = "doc_id long, version string, batch long"
PART_ROWS = 1 << 21  # of a compacted file, which a task sorts
COMPACTED = -1  # the batch of compacted rows, before any of a stream


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path, fs = _path(spark, f"{folder}/{name}")
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if fs.exists(path) else spark.createDataFrame([], schema)


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, version and batch of the newest version of each document."""
    return _read(spark, folder, "versions", VERSIONS).groupBy("doc_id").agg(F.max_by("version", "batch").alias("version"), F.max("batch").alias("batch"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The postings of the newest version of each document: term, doc_id, tf."""
    live = newest(spark, folder).select("doc_id", "batch")
    packed = _read(spark, folder, "words", WORDS).filter("n > 0").select("doc_id", "batch", "terms", "tfs").join(live, ["doc_id", "batch"])
    each = packed.select("doc_id", F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.split("tfs", " ").alias("tf"))).alias("x"))
    held = _read(spark, folder, "postings", POSTINGS).select("term", "doc_id", "tf").join(live.filter(F.col("batch") == COMPACTED).select("doc_id"), "doc_id")
    return each.select("x.term", "doc_id", F.col("x.tf").cast("long").alias("tf")).unionByName(held)


def packed_words(docs: DataFrame) -> DataFrame:
    """The columns of docs (one of them text) and, for the text, n distinct terms, these terms in order and how often each occurs, joined by spaces."""
    rows = docs.withColumn("toks", F.sort_array(tokens(F.col("text"))))
    rows = rows.withColumn("starts", F.expr("if(size(toks) = 0, cast(array() AS array<int>), filter(sequence(1, size(toks)), i -> i = 1 OR toks[i - 1] <> toks[i - 2]))"))
    terms = F.expr("array_join(transform(starts, i -> toks[i - 1]), ' ')")
    tfs = F.expr("array_join(transform(starts, (i, k) -> cast(if(k + 1 < size(starts), starts[k + 1], size(toks) + 1) - i AS string)), ' ')")
    return rows.select(*docs.columns, F.size("starts").alias("n"), terms.alias("terms"), tfs.alias("tfs"))


def upsert(batch: DataFrame, batch_id: int, folder: str, order_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Index the documents of a batch that are not indexed in this version; writing a batch twice changes nothing."""
    spark = batch.sparkSession
    place = F.struct(F.col(order_col) if order_col else F.lit(0), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    last = batch.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(place)["text"].alias("text"))
    last = last.withColumn("version", F.md5(F.col("text").cast("binary")))
    held = _read(spark, folder, "versions", VERSIONS).filter(F.col("batch") != batch_id).groupBy("doc_id").agg(F.max_by("version", "batch").alias("version"))
    # by the id alone, by which texts are dealt already
    fresh = last.join(held.select("doc_id", F.col("version").alias("had")), "doc_id", "left").filter("had IS NULL OR had <> version").drop("had")
    number = F.lit(batch_id).cast("long").alias("batch")
    words = f"{folder}/words/part={batch_id}"
    packed_words(fresh).select("doc_id", "version", number, "n", "terms", "tfs").write.mode("overwrite").parquet(words)
    spark.read.schema(WORDS).parquet(words).select("doc_id", "version", "batch").write.mode("overwrite").parquet(f"{folder}/versions/part={batch_id}")


def clear(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def compact(spark: SparkSession, folder: str, target: str, parts: int) -> None:
    """Write the live postings into a few files of another folder, dealt by term, with the newest versions; also a backup.

    parts: the files, at least; more where one would have over PART_ROWS rows, and then a term of very many documents has several.
    """
    number = F.lit(COMPACTED).cast("long").alias("batch")
    rows, held = read_index(spark, folder).select("term", "doc_id", "tf", number), newest(spark, folder).select("doc_id", "version", number)
    # upper bounds: rows of files and the counts in them
    files = lambda n: max(parts, -(-n // PART_ROWS))
    n = files(_read(spark, folder, "postings", POSTINGS).count() + (_read(spark, folder, "words", WORDS).agg(F.sum("n")).first()[0] or 0))
    dealt = rows.repartition(n, "term") if n == parts else rows.repartitionByRange(n, "term", "doc_id")
    dealt.sortWithinPartitions("term", "doc_id").write.mode("error").parquet(f"{target}/postings/part={COMPACTED}")
    held.repartition(files(_read(spark, folder, "versions", VERSIONS).count()), "doc_id").write.mode("error").parquet(f"{target}/versions/part={COMPACTED}")


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row about the live index: documents (also those without terms), terms, postings and occurrences."""
    held = newest(spark, folder).agg(F.count("*").alias("documents"))
    live = read_index(spark, folder).agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("occurrences"))
    return held.crossJoin(live)  # a row each


def export(report: DataFrame, target: str, kind: str = "json") -> None:
    """Write a report or search results as files (json, csv with a header, parquet); an existing target is an error."""
    report.write.mode("error").options(**({"header": True} if kind == "csv" else {})).format(kind).save(target)


def index_stream(docs: DataFrame, folder: str, checkpoint: str, order_col: str | None = None) -> StreamingQuery:
    """Keep the index up to date with a stream of documents (doc_id, text)."""
    return docs.writeStream.foreachBatch(lambda b, i: upsert(b, i, folder, order_col)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
