"""An inverted file of vectors: lists around k-means centres, of which a search reads a few.

Centres are fitted by cosine on at most SAMPLE_PER_LIST vectors a list, those with the smallest hash
of their id (the bound is a parameter); every vector is then put into the list of its nearest
centre and written in blocks, sorted by list, so that a list of any size is many rows. A search
finds the `probes` nearest centres of each query and compares it, exactly, with the vectors of
those lists: blocks of queries meet blocks of lists, and which of them probe a list is worked out there.
How many probes it takes is measured when the index is built: CALIBRATION vectors are
searched for exactly, and the least number that reaches TARGET of their neighbours is kept with the
index. Vectors that form no clusters need many. `search.nearest` is the exact way; `recall` says how
much of its result was found.

Centres are broadcast: there are as many as the index was asked for, at most MOST_LISTS.

Defined cases: rows without an id are left out. Vectors that are null or zero, hold null or
non-finite components, or have another width than most are kept in list -1, which no search probes;
a query of that kind finds nothing. No vector is its own neighbour. Repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import BLOCK, SLICE, _packed, best_of_blocks, nearest

SAMPLE_PER_LIST = 256
MOST_LISTS = 1 << 14
LANE_LISTS = 32  # blocks of lists that a task compares with one block of queries
NO_LIST = -1
CALIBRATION = 200  # vectors that are searched for exactly when an index is built
TARGET = 0.93  # of their NEIGHBOURS nearest that a search must find
NEIGHBOURS = 10


def _usable(vector: Column, width: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))


def _unit(b: pa.RecordBatch, width: int) -> np.ndarray:
    x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _nearest_lists(rows: DataFrame, centres, probes: int) -> DataFrame:
    """list, id and vector: each row once for each of its `probes` nearest centres."""
    width, many = centres.value.shape[1], min(probes, centres.value.shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                dots = _unit(part, width) @ c.T
                best = np.argpartition(-dots, many - 1, axis=1)[:, :many]
                again = pa.array(np.repeat(np.arange(part.num_rows), many))
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), part.column("id").take(again), part.column("vector").take(again)], ["list", "id", "vector"])

    return rows.mapInArrow(run, "list int, id long, vector array<double>")


def _blocks(rows: DataFrame, parts: int, size: int, prefix: str) -> DataFrame:
    """Rows (list, id, vector) as blocks of one list; a list may have blocks in several partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            lists = b.column("list").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(lists[1:] != lists[:-1]) + 1, [len(lists)]]) if len(lists) else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                for at in range(i, j, size):
                    part = b.slice(at, min(size, j - at))
                    x = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                    cells = [int(lists[i]), number, len(x) // part.num_rows, part.column("id").to_numpy().tobytes(), x.tobytes()]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names)
                    number += 1

    names = ["list", *(f"{prefix}_{c}" for c in ("block", "width", "ids", "data"))]
    schema = f"list int, {prefix}_block long, {prefix}_width int, {prefix}_ids binary, {prefix}_data binary"
    return rows.repartitionByRange(parts, "list", "id").sortWithinPartitions("list", "id").mapInArrow(run, schema)


def build(vectors: DataFrame, folder: str, lists: int | None = None, per_list: int = SAMPLE_PER_LIST, target: float = TARGET, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Write an index of all rows into an empty folder. lists: the square root of the number of rows where not given."""
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col)
    widths = rows.filter("vector IS NOT NULL").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths["width"] if widths else 0
    usable = rows.filter(_usable(F.col("vector"), width))
    n = usable.count()
    k = min(lists or int(np.ceil(np.sqrt(n))), MOST_LISTS, max(n, 1))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if n:
        sample = usable.orderBy(F.xxhash64("id"), "id").limit(k * per_list).select(array_to_vector("vector").alias("features"))
        found = np.array(KMeans(k=k, seed=seed, maxIter=15, distanceMeasure="cosine").fit(sample).clusterCenters()) if k > 1 else np.ones((1, width))
        found = found / np.sqrt((found**2).sum(axis=1))[:, None]
    else:
        found = np.zeros((0, width))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "list int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
    placed = rows.filter(~_usable(F.col("vector"), width)).select(F.lit(NO_LIST).alias("list"), "id", F.coalesce("vector", F.array().cast("array<double>")).alias("vector"))
    if n:
        placed = placed.unionByName(_nearest_lists(usable, spark.sparkContext.broadcast(found), 1))
    _one_width(placed, parts).write.parquet(f"{folder}/lists")
    probes = _probes(usable, found, target) if n else 0
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{folder}/probes")


def _probes(usable: DataFrame, centres: np.ndarray, target: float) -> int:
    """The least number of probes that reaches the share of neighbours, over a sample of fixed size."""
    spark = usable.sparkSession
    sample = usable.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(CALIBRATION)
    asked = {r["id"]: r["vector"] for r in sample.collect()}
    chosen = spark.createDataFrame(list(asked.items()), "vec_id long, embedding array<double>")
    exact = nearest(chosen, usable.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), NEIGHBOURS)
    found = exact.select("query_id", "vec_id").join(usable.select(F.col("id").alias("vec_id"), "vector"), "vec_id").collect()  # CALIBRATION * NEIGHBOURS rows, but for repeated ids
    if not found:
        return 1
    order = {i: np.argsort(np.argsort(-(centres @ (np.array(v) / np.abs(v).max())), kind="stable")) for i, v in asked.items()}
    depth = np.sort([order[r["query_id"]][int((centres @ (np.array(r["vector"]) / np.abs(r["vector"]).max())).argmax())] for r in found])
    return int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))) - 1)]) + 1


def _one_width(placed: DataFrame, parts: int) -> DataFrame:
    """Blocks of the lists; vectors of the odd list, which is only kept, lose what has no width in common."""
    odd = placed.filter(F.col("list") == NO_LIST).select("list", "id", F.array().cast("array<double>").alias("vector"))
    return _blocks(placed.filter(F.col("list") != NO_LIST).unionByName(odd), parts, BLOCK, "v")


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest vectors in the `probes` nearest lists of each query (as many as the index was built with where not given)."""
    probes = probes or spark.read.parquet(f"{folder}/probes").first()["probes"]
    centres = spark.read.parquet(f"{folder}/centres").orderBy("list").limit(MOST_LISTS).collect()
    none = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    if not centres:
        return none
    c = spark.sparkContext.broadcast(np.array([r["centre"] for r in centres]))
    asked = _rows(queries, id_col, vector_col)
    asked = asked.filter(_usable(F.col("vector"), c.value.shape[1]))
    v = spark.read.parquet(f"{folder}/lists").filter(F.col("list") != NO_LIST)
    least, many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), min(probes, len(centres))

    def probed(x: np.ndarray) -> np.ndarray:
        best = np.argpartition(-(x @ c.value.T), many - 1, axis=1)[:, :many]
        out = np.zeros((len(x), c.value.shape[0]), bool)
        np.put_along_axis(out, best, True, axis=1)
        return out

    # a query is sent as often as there are lanes of lists, whatever its probes
    lanes_q, lanes_v = max(1, -(-asked.count() // BLOCK)), max(least, -(-v.count() // LANE_LISTS))
    lanes = v.withColumn("lane", F.pmod(F.xxhash64("v_block"), F.lit(lanes_v)).cast("int")).repartitionById(lanes_v, F.col("lane")).drop("lane")
    pairs = _packed(asked, lanes_q, "q", "float64").hint("shuffle_replicate_nl").crossJoin(lanes)
    scored = pairs.mapInArrow(best_of_blocks(k, "float64", probed), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found, or others that are as near as the last of them."""
    last = exact.filter("score IS NOT NULL").groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.join(last, "query_id", "right").groupBy("query_id").agg(F.count_if(F.col("score") >= F.col("least")).alias("hits"), F.first("n").alias("n"))
    row = hits.agg(F.sum(F.least("hits", "n")).alias("hits"), F.sum("n").alias("n")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
