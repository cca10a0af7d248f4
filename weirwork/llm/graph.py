"""Connected components over edges of any number, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, skewed_join

JUMPS = 2


def hooked(edges: DataFrame, tables: Tables, jumps: int = JUMPS) -> DataFrame:
    """node and label: each node follows its neighbour with the most edges, up to 2**jumps times.

    Nodes of one label are connected. Ties go by a hash of the node, so chains are short. Hubs are no
    hot keys: what is known of those with more than a share of all edges is broadcast.
    """
    both = tables.cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))))
    degrees = both.groupBy("node").agg(F.count("*").alias("degree"))
    mine = tables.cut(degrees.select("node", F.struct("degree", F.xxhash64("node").alias("h"), F.col("node").alias("v")).alias("me")))
    theirs = mine.select(F.col("node").alias("other"), F.col("me").alias("they"), F.col("me.degree").alias("n_rows"))
    best = skewed_join(both, theirs, ["other"]).groupBy("node").agg(F.max("they").alias("they"))
    labels = tables.cut(best.join(mine, "node").select("node", F.greatest("they", "me")["v"].alias("label")))
    for _ in range(jumps):
        # few labels are left, so a table of where they lead is small
        up = labels.join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = labels.join(up, "label").select("node", F.col("next").alias("label"))
    return labels


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node and root (a node of its component, the same for all) for every node of an edge (columns a, b).

    Every round lets each node follow its largest neighbours and draws the edges between the labels
    that are left; the number of labels falls by a factor a round. Null ends and loops are ignored.
    The result lies in `tables` if given, else in a checkpoint.
    """
    if tables is None:
        with Tables(edges.sparkSession, "components") as own:
            return cut(components(edges, own))
    now = tables.cut(edges.filter("a <> b").select("a", "b").distinct())
    place = None
    while not now.isEmpty():
        labels = tables.cut(hooked(now, tables))
        la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = now.join(la, "a").join(lb, "b").filter("la <> lb")
        now = tables.cut(left.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if place is None:
            place = labels.withColumnRenamed("label", "root")
        else:
            moved = labels.withColumnsRenamed({"node": "root", "label": "moved"})
            place = tables.cut(place.join(moved, "root", "left").select("node", F.coalesce("moved", "root").alias("root")))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) if place is None else place
