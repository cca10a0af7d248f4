"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine c or more lie within epsilon = sqrt(2 - 2c) of each other, and so do their
projections. Vectors are sorted by the cells of an epsilon grid on their leading principal
dimensions and cut into blocks, consecutive intervals of that sequence. Pairs of intervals are
joined recursively, from the whole sequence down: a pair whose bounding boxes are farther apart
than epsilon is skipped with all below it. Down to blocks this is a join of interval tables; within
a pair of blocks it goes on in one task, down to leaves whose vectors are compared, first by the
leading dimensions, then exactly in double precision.

Surviving pairs are dealt by tiles of the blocks' triangle: a task gets each block of a tile once,
holds the blocks of one side and streams those of the other. The number of tiles depends on the
session, not on the data, until a side would no longer fit into HELD_BYTES, so a block is shipped
a few times whatever the number of pairs.

Vectors that agree in 128 bits of hashes are one class with a number of copies. A pair of blocks
gives each class's number of links and the edges of a spanning forest of its links, so a dense
group costs rows in proportion to its size, not to its square.

Vectors of floats are kept and packed as floats, all others as doubles.

The principal dimensions come from at most SAMPLE classes; they steer the order only, any basis
gives the same links.

Defined cases: null and zero vectors and vectors with null or non-finite components link with
nothing and stay their own component; so do vectors of different length with each other. Repeated
rows are vectors of their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Tables, cut, skewed_join
from .graph import components

SAMPLE = 20_000
GRID = 8  # leading dimensions of the grid order
LEAD = 16  # leading dimensions of bounding boxes and of the first comparison
BLOCK = 4096
LEAF = 512
FAN = 8
HELD_BYTES = 512 << 20  # of the vectors that one task holds, as doubles with what is derived from them
BOX = [f"{side}_{i}" for side in ("lo", "hi") for i in range(LEAD)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal(sample: np.ndarray, width: int) -> np.ndarray:
    """The leading principal directions as columns (width x LEAD; zero columns beyond the width)."""
    out = np.zeros((width, LEAD))
    x = _unit(sample)
    x = x - x.mean(axis=0)
    _, vectors = np.linalg.eigh(x.T @ x)
    k = min(LEAD, width)
    out[:, :k] = vectors[:, ::-1][:, :k]
    return out


def grid_key(lead: np.ndarray, epsilon: float) -> np.ndarray:
    """The cells of the grid, most significant dimension first, as one ascending integer."""
    cells = np.clip(np.floor(lead[:, :GRID] / epsilon), -128, 127).astype(np.int64) + 128
    key = np.zeros(len(lead), np.uint64)
    for i in range(GRID):
        key = (key << np.uint64(8)) | cells[:, i].astype(np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


@dataclass
class Side:
    """The vectors of a block: unit vectors, leading dimensions, their squares, boxes of its leaves, copies."""

    unit: np.ndarray
    lead: np.ndarray
    square: np.ndarray
    low: np.ndarray
    high: np.ndarray
    copies: np.ndarray

    @staticmethod
    def of(x: np.ndarray, copies: np.ndarray, basis: np.ndarray) -> Side:
        unit = _unit(x)
        lead = unit @ basis
        at = np.arange(0, len(x), LEAF)
        return Side(unit, lead, np.einsum("ij,ij->i", lead, lead), np.minimum.reduceat(lead, at), np.maximum.reduceat(lead, at), copies)


class Forest:
    """Spanning forest of the links of one pair of blocks."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _roots(self) -> np.ndarray:
        while True:
            two = self.up[self.up]
            if (two == self.up).all():
                return two
            self.up = two

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self._roots()
        ra, rb = roots[a], roots[b]
        apart = np.flatnonzero(ra != rb)
        if not len(apart):
            return
        _, first = np.unique(np.minimum(ra, rb)[apart] * len(self.up) + np.maximum(ra, rb)[apart], return_index=True)
        for i in apart[first].tolist():
            x, y = int(ra[i]), int(rb[i])
            while self.up[x] != x:
                x = int(self.up[x])
            while self.up[y] != y:
                y = int(self.up[y])
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.edges.append((int(a[i]), int(b[i])))


def join_blocks(one: Side, two: Side, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links (copies counted) of either block's vectors, and a spanning forest (two's vectors come after one's)."""
    epsilon2 = 2 - 2 * cosine + 1e-9
    n, m = len(one.unit), len(two.unit)
    links_one, links_two = np.zeros(n, np.int64), np.zeros(m, np.int64)
    forest = Forest(n if same else n + m)
    shift = 0 if same else n
    todo = [(0, len(one.low), 0, len(two.low))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and a0 >= b1:
            continue  # the mirror image of another pair
        gap = np.maximum(0, np.maximum(two.low[b0:b1].min(axis=0) - one.high[a0:a1].max(axis=0), one.low[a0:a1].min(axis=0) - two.high[b0:b1].max(axis=0)))
        if gap @ gap > epsilon2:
            continue
        if a1 - a0 > 1 or b1 - b0 > 1:
            am, bm = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
            for x in ((a0, am), (am, a1)):
                for y in ((b0, bm), (bm, b1)):
                    if x[0] < x[1] and y[0] < y[1]:
                        todo.append((*x, *y))
            continue
        if same and a0 > b0:
            continue
        s, t = slice(a0 * LEAF, min((a0 + 1) * LEAF, n)), slice(b0 * LEAF, min((b0 + 1) * LEAF, m))
        near = one.square[s, None] + two.square[None, t] - 2 * (one.lead[s] @ two.lead[t].T) <= epsilon2
        i, j = np.nonzero(np.triu(near, 1) if same and a0 == b0 else near)
        if not len(i):
            continue
        i, j = i + s.start, j + t.start
        if len(i) > LEAF * LEAF // 8:
            dots = (one.unit[s] @ two.unit[t].T)[i - s.start, j - t.start]
        else:
            dots = np.einsum("ij,ij->i", one.unit[i], two.unit[j])
        hit = dots >= cosine
        i, j = i[hit], j[hit]
        np.add.at(links_one, i, two.copies[j])
        np.add.at(links_one if same else links_two, j, one.copies[i])
        forest.add(i, j + shift)
    return links_one, links_two, forest.edges


def _blocks(classes: DataFrame, width: int, basis: np.ndarray, epsilon: float, tables: Tables) -> DataFrame:
    """block (number in the sequence), box of the leading dimensions, and the packed vectors."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lead = _unit(_matrix(b.column("vector"), width)) @ basis
                yield b.append_column("grid", pa.array(grid_key(lead, epsilon)))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield b.drop_columns(["grid"]).append_column("part", pa.array(np.full(b.num_rows, part, np.int32))).append_column("place", pa.array(np.arange(n, n + b.num_rows)))
            n += b.num_rows

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            blocks = rows.column("block").to_numpy()
            for block in np.unique(blocks).tolist():
                part = rows.filter(pa.array(blocks == block)).combine_chunks()
                x = _matrix(part.column("vector"), width)
                lead = _unit(x) @ basis
                box = [*lead.min(axis=0), *lead.max(axis=0)]
                cells = [block, *box, part.column("cls").to_numpy().tobytes(), part.column("copies").to_numpy().tobytes(), x.tobytes()]
                kinds = [pa.int64(), *[pa.float64()] * len(box), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["block", *BOX, "ids", "copies", "vectors"])

        for b in batches:  # a block a partition
            held.append(b)
        if held:
            yield from emit()

    n = classes.count()
    kind = f"cls long, copies long, vector {classes.schema['vector'].dataType.simpleString()}"
    order = classes.select("cls", "copies", "vector").mapInArrow(keyed, f"{kind}, grid long").repartitionByRange(max(1, n // (2 * BLOCK)), "grid", "cls").sortWithinPartitions("grid", "cls")
    places = tables.cut(order.mapInArrow(numbered, f"{kind}, part int, place long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = places.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    # blocks are equal intervals of the whole sequence, however many partitions it was sorted in
    block = F.floor((F.col("offset") + F.col("place")) / F.lit(BLOCK)).cast("long")
    spread = places.join(offsets, "part").select("cls", "copies", "vector", block.alias("block")).repartitionById(-(-n // BLOCK), F.col("block").cast("int"))
    return spread.mapInArrow(packed, f"block long, {', '.join(f'{c} double' for c in BOX)}, ids binary, copies binary, vectors binary")


def _near_pairs(blocks: DataFrame, epsilon2: float, tables: Tables) -> DataFrame:
    """Pairs of blocks (one <= two) whose boxes are within epsilon, found by descending interval pairs."""
    boxes = blocks.select("block", *BOX)
    n, height = boxes.count(), 0
    while FAN**height < n:
        height += 1
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"))
    for level in range(height - 1, -1, -1):
        node = F.floor(F.col("block") / F.lit(FAN**level)).cast("long")
        mine = boxes.groupBy(node.alias("node")).agg(*(F.min(c).alias(c) if c.startswith("lo") else F.max(c).alias(c) for c in BOX))
        kids = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
        pairs = pairs.select(kids("one").alias("one"), "two").select("one", kids("two").alias("two")).filter("one <= two")
        a = mine.select(F.col("node").alias("one"), *(F.col(c).alias(f"a_{c}") for c in BOX))
        b = mine.select(F.col("node").alias("two"), *(F.col(c).alias(f"b_{c}") for c in BOX))
        gap = F.lit(0.0)
        for i in range(LEAD):
            g = F.greatest(F.lit(0.0), F.col(f"b_lo_{i}") - F.col(f"a_hi_{i}"), F.col(f"a_lo_{i}") - F.col(f"b_hi_{i}"))
            gap = gap + g * g
        pairs = tables.cut(pairs.join(a, "one").join(b, "two").filter(gap <= epsilon2).select("one", "two"))
    return pairs


def _links(classes: DataFrame, width: int, cosine: float, tables: Tables) -> DataFrame:
    """Rows (cls, links, null) and (cls, null, other): numbers of links, and edges."""
    spark = classes.sparkSession
    epsilon = float(np.sqrt(2 - 2 * cosine))
    sample = classes.orderBy("cls").limit(SAMPLE).select("vector").toArrow()
    basis = principal(_matrix(sample.column("vector"), width), width)
    blocks = tables.cut(_blocks(classes, width, basis, epsilon, tables))
    pairs = _near_pairs(blocks, epsilon**2 + 1e-9, tables)
    dtype = np.float32 if classes.schema["vector"].dataType.elementType == FloatType() else np.float64
    # blocks along a tile's side: enough tiles for all cores, and no more than a task can hold
    wanted = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    fit = max(1, HELD_BYTES // (BLOCK * (2 * width + 2 * LEAD) * 8))
    side_of = max(1, min(fit, int(blocks.count() / np.sqrt(2 * wanted))))
    tile = lambda c: F.floor(F.col(c) / F.lit(side_of)).cast("long")
    placed = pairs.select(tile("one").alias("row"), tile("two").alias("column"), "one", "two")
    needs = placed.select("row", "column", F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("one").alias("block")), F.struct(F.when(F.col("row") == F.col("column"), 0).otherwise(1).alias("role"), F.col("two").alias("block")))).alias("x"))
    needs = tables.cut(needs.select("row", "column", "x.role", "x.block").distinct())
    tiles = max(1, needs.select("row", "column").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for at in range(b.num_rows):
                row = {name: b.column(name)[at].as_py() for name in b.schema.names}
                if now != (row["row"], row["column"]):
                    now, held = (row["row"], row["column"]), []
                here = Side.of(np.frombuffer(row["vectors"], dtype).reshape(-1, width), np.frombuffer(row["copies"], np.int64), basis), np.frombuffer(row["ids"], np.int64)
                found = [(other, here, False) for other in held]
                if row["role"] == 0:
                    if now[0] != now[1]:
                        found = []
                    else:
                        found.append((here, here, True))
                    held.append(here)
                for (one, ids_one), (two, ids_two), same in found:
                    links_one, links_two, edges = join_blocks(one, two, same, cosine)
                    ids = ids_one if same else np.concatenate([ids_one, ids_two])
                    links = links_one if same else np.concatenate([links_one, links_two])
                    some = np.flatnonzero(links)
                    ends = np.array(edges, np.int64).reshape(-1, 2)
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate([ids[some], ids[ends[:, 0]]])), pa.concat_arrays([pa.array(links[some]), pa.nulls(len(ends), pa.int64())]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[ends[:, 1]])])],
                            ["cls", "links", "other"],
                        )

    fed = needs.join(blocks.select("block", "ids", "copies", "vectors"), "block").repartition(tiles, "row", "column").sortWithinPartitions("row", "column", "role", "block")
    return fed.select("row", "column", "role", "ids", "copies", "vectors").mapInArrow(run, "cls long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable by links) and kept of every row."""
    single = vectors.schema[vector_col].dataType.elementType == FloatType()
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    usable = F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), usable.alias("ok"))
    keyed = rows.filter("ok").select("vec_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "vector")
    with Tables(vectors.sparkSession, "vectors") as tables:
        classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
        classes = tables.cut(classes.withColumn("cls", F.monotonically_increasing_id()))
        found = None
        for r in classes.groupBy(F.size("vector").alias("width")).count().orderBy("width").collect():
            part = _links(classes.filter(F.size("vector") == r["width"]), r["width"], cosine, tables)
            found = part if found is None else found.unionByName(part)
        none = keyed.sparkSession.createDataFrame([], "cls long, links long, other long")
        found = tables.cut(none if found is None else found)
        roots = components(found.filter("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")), tables).withColumnRenamed("node", "cls")
        totals = found.filter("links IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("links"))
        known = tables.cut(classes.select("cls", "h1", "h2", "least", "copies").join(totals, "cls", "left").join(roots, "cls", "left"))
        linked = known.filter("root IS NOT NULL")
        least = tables.cut(linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n_rows")))
        out = lambda d, c: d.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col(c).alias("component"), F.col("copies").alias("n_rows"))
        facts = tables.cut(out(skewed_join(linked, least, ["root"]), "component").unionByName(out(known.filter("root IS NULL AND copies > 1"), "least")))
        told = skewed_join(keyed.select("vec_id", "h1", "h2"), facts, ["h1", "h2"]).select("vec_id", "n_links", "component")
        alone = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
        done = told.unionByName(alone).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        return cut(done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
