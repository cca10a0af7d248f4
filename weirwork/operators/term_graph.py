"""A knowledge graph of terms: pointwise mutual information, personalised PageRank, expanded search.

Two terms are linked if they stand side by side more often than by chance: with c(a, b) the times
that a and b do, in either order, c(a) the sum over all partners of a and n the sum over all pairs,
an edge's weight is ln(c(a, b) * 2n / (c(a) c(b))) where that is positive and c(a, b) is at least
`least`. PageRank with restart at the seeds: of a node's rank the share DAMPING goes along its
edges by weight and the rest to the seeds; nodes without edges give all to the seeds. A fixed number
of rounds; ranks sum to one. Semantics are this project's own.

Ranks and edges are joined by shuffle, for which the edges are dealt out by source once and kept, in
memory or on the executors' disks, for all rounds; only ranks travel in a round. A node has no more
edges than there are terms, and shares are summed by target before they are shuffled. Defined cases: seeds
that are no node are ignored; without any the result is empty. Repeated seeds count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Tables, cut
from .search import edges

DAMPING = 0.85
ROUNDS = 12


def associations(docs: DataFrame, least: int = 2, text_col: str = "text") -> DataFrame:
    """source, target (source < target), times and pmi of the terms that attract each other."""
    with Tables(docs.sparkSession, "associations") as tables:
        pairs = tables.cut(edges(docs, text_col))
        both = pairs.select(F.col("source").alias("term"), "weight").unionByName(pairs.select(F.col("target").alias("term"), "weight"))
        per = tables.cut(both.groupBy("term").agg(F.sum("weight").alias("total")))
        n = (pairs.agg(F.sum("weight").alias("n")).first()["n"] or 0) * 2
        kept = pairs.filter(F.col("weight") >= least)
        for side in ("source", "target"):
            kept = kept.join(per.select(F.col("term").alias(side), F.col("total").alias(f"of_{side}")), side)
        pmi = F.log(F.col("weight") * F.lit(float(n)) / (F.col("of_source").cast("double") * F.col("of_target")))
        return cut(kept.select("source", "target", F.col("weight").alias("times"), pmi.alias("pmi")).filter("pmi > 0"))


def page_rank(graph: DataFrame, seeds: Sequence[str], weight: str = "pmi", rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """term and rank of the nodes that can be reached from the seeds. graph: source, target and a weight, undirected."""
    spark = graph.sparkSession
    with Tables(spark, "ranks") as tables:
        one = graph.select("source", "target", F.col(weight).alias("w"))
        arcs = tables.cut(one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "w")))
        out = arcs.groupBy("source").agg(F.sum("w").alias("all"))
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        arcs = arcs.join(out, "source").select("source", "target", (F.col("w") / F.col("all")).alias("share"))
        # dealt by source once and kept so: from files every round would shuffle all arcs again
        arcs = arcs.repartition(parts, "source").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _ranks(arcs, list(dict.fromkeys(seeds)), rounds, damping, tables)
        finally:
            arcs.unpersist()


def _ranks(arcs: DataFrame, wanted: list[str], rounds: int, damping: float, tables: Tables) -> DataFrame:
    """term and rank after all rounds. arcs: source, target and share, dealt by source."""
    spark = arcs.sparkSession
    there = [r["source"] for r in arcs.filter(F.col("source").isin(wanted)).select("source").distinct().collect()]  # at most the seeds
    if not there:
        return spark.createDataFrame([], "term string, rank double")
    start = spark.createDataFrame([(t, 1.0 / len(there)) for t in sorted(there)], "term string, start double")
    ranks = tables.cut(start.select("term", F.col("start").alias("rank")))
    for _ in range(rounds):
        ranks = tables.cut(_round(ranks, arcs, start, damping))
    return cut(ranks)


def _round(ranks: DataFrame, arcs: DataFrame, start: DataFrame, damping: float) -> DataFrame:
    sent = ranks.join(arcs, ranks["term"] == arcs["source"]).groupBy(F.col("target").alias("term")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
    # every node that is reached has edges, so what is not sent is the restart
    return sent.join(F.broadcast(start), "term", "full_outer").select("term", (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) * F.coalesce("start", F.lit(0.0))).alias("rank"))


def expand(graph: DataFrame, terms: Sequence[str], most: int = 5) -> list[str]:
    """The terms and the `most` others of the highest rank around them, to search with."""
    near = page_rank(graph, terms).filter(~F.col("term").isin(list(terms))).orderBy(F.desc("rank"), "term").limit(most)
    return [*dict.fromkeys(terms), *(r["term"] for r in near.collect())]
