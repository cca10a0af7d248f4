"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output over its share of the
input. Every document draws its number of copies by inverting the Poisson distribution of its
source's rate at a uniform number hashed from the seed and its id, so the draw depends on nothing
but these and survives any retry. Rates above CHUNK are drawn as sums of equal Poisson parts.
The copies are dealt to partitions by a second hash and sorted by it within them: a global
shuffle without sampling.

Rates of up to FEW_SOURCES sources are broadcast; of more, only those of sources with more than a
share of all rows, and the others are joined by shuffle.

Defined cases: a null source is a source of its own. A null doc_id hashes as the word null.
Repeated rows are drawn alike, each for itself. Null and empty texts count as no characters; if a
source (or everything) has no characters, its rate is 0. Sources without a target weight get 0.
An empty table gives no rows. Extra columns stay; one of this operator's own columns gets
underscores before its name where the documents have a column of that name already.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, skewed_join

CHUNK = 16.0
TAIL = 80  # terms of the distribution of a part; what lies beyond is under 1e-30 for CHUNK
FEW_SOURCES = 10_000  # rates of so many sources at most are broadcast; more are joined by shuffle
OWN = ("copy_no", "n_copies", "mix_rate", "shuffle_key")


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 48 bits from the md5 of the parts joined by '|'."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None, scale: float, source_col: str, text_col: str) -> DataFrame:
    """source_key, rate, parts, cdf and n_rows: one row a source. Without weights all sources get the same."""
    size = F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long")
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("chars"), F.count("*").alias("n_rows"))
    if weights is None:
        per = per.withColumn("w", F.lit(1.0))
    else:
        pairs = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        per = per.withColumn("w", F.coalesce(*pairs, F.lit(0.0)))
    sums = per.agg(F.sum("chars").alias("all"), F.sum("w").alias("ws"))
    rate = F.when((F.col("chars") > 0) & (F.col("ws") > 0), F.lit(float(scale)) * F.col("all") * F.col("w") / F.col("ws") / F.col("chars")).otherwise(F.lit(0.0))
    # one row is joined to the few of the sources
    rated = per.join(F.broadcast(sums)).select(_key(F.col("source")).alias("source_key"), "n_rows", rate.alias("rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(CHUNK))).cast("int")
    rated = rated.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TAIL)),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda a, k: F.struct(
            (a["p"] * F.col("mean") / k).alias("p"),
            F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("mean") / k)).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return rated.select("source_key", "rate", "parts", steps.alias("cdf"), "n_rows")


def _key(source: Column) -> Column:
    """A source as text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    scale: float = 1.0,
    seed: int = 20240601,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The documents, each copy a row, with copy_no (from 0), n_copies, mix_rate and shuffle_key.

    weights: target share of output characters by source (any scale); scale: output characters
    over input characters.
    """
    copy_no, n_copies, mix_rate, shuffle_key = (free_name(docs, c) for c in OWN)
    key, rate, parts, cdf, u = (free_name(docs, f"mixing_{c}") for c in ("key", "rate", "parts", "cdf", "u"))
    rates = cut(source_rates(docs, weights, scale, source_col, text_col)).withColumnsRenamed({"source_key": key, "rate": rate, "parts": parts, "cdf": cdf})
    keyed = docs.withColumn(key, _key(F.col(source_col)))
    joined = keyed.join(F.broadcast(rates.drop("n_rows")), key) if rates.count() <= FEW_SOURCES else skewed_join(keyed, rates, [key])
    draw = lambda i: F.size(F.filter(cdf, lambda c: c <= hashed_uniform(F.lit(seed), F.col(id_col), i)))
    one = F.when(F.col(parts) == 1, F.size(F.filter(cdf, lambda c: c <= F.col(u))))
    more = F.aggregate(F.sequence(F.lit(0), F.col(parts) - 1), F.lit(0), lambda a, i: a + draw(i))
    counted = joined.withColumn(u, hashed_uniform(F.lit(seed), F.col(id_col), F.lit(0))).withColumn(n_copies, F.coalesce(one, more))
    copies = (
        counted.filter(F.col(n_copies) > 0)
        .withColumn(copy_no, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1)))
        .withColumn(shuffle_key, hashed_uniform(F.lit(seed + 1), F.col(id_col), F.col(copy_no)))
    )
    spread = copies.repartition(F.col(shuffle_key), F.col(copy_no), F.col(id_col)).sortWithinPartitions(shuffle_key, id_col)
    return spread.select(*docs.columns, copy_no, n_copies, F.col(rate).alias(mix_rate), shuffle_key)
