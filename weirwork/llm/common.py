"""Shared plumbing: lineage cuts, partition sizing, Arrow slicing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Tables, cut, new_folder, remove  # noqa: F401  for the operators
from .kernel import contents as utf8

SLICE_BYTES = 4 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, in case they do not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="weirwork-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


_kept: dict[tuple, object] = {}


def kept(kind: type, path: str):
    """The one coder that a worker keeps between tasks (kind(path)); what another operator kept goes first."""
    if (kind, path) not in _kept:
        free_worker()
        _kept[kind, path] = kind(path)
    return _kept[kind, path]


def free_worker() -> None:
    """Give back what earlier operators kept or left in this worker; to be called where another one begins."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that frees the worker before a task and gives its memory back after it: idle workers live on for a while."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        yield from run(batches)
        free_worker()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UNKNOWN_BYTES = 1 << 52  # plans without statistics claim more than this


def partitions(spark: SparkSession, scanned: DataFrame | None = None, each: int = 1) -> int:
    """The session's number of shuffle partitions, or more if the scanned files have more than `each` bytes for one."""
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if scanned is None:
        return least
    size = int(str(scanned._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > UNKNOWN_BYTES else max(least, -(-size // each))


HOT_KEYS = 10_000


def skewed_join(many: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of many rows with facts about their keys (one row a key; n_rows: how many rows of `many` it has).

    Keys with more than 1/HOT_KEYS of all rows are broadcast: there are at most HOT_KEYS of them,
    whatever the data. All others are joined by shuffle. Both sides should be cheap to read twice.
    """
    names = [c for c in facts.columns if c not in (*keys, "n_rows")]
    share = facts.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    hot = F.broadcast(facts.filter(F.col("n_rows") * HOT_KEYS > F.lit(max(share, HOT_KEYS))).select(*keys, *names))
    cold = facts.filter(F.col("n_rows") * HOT_KEYS <= F.lit(max(share, HOT_KEYS))).select(*keys, *names)
    rest = many.join(hot.select(*keys), keys, "left_anti").join(cold, keys, "left")
    return many.join(hot, keys).unionByName(rest)


class Tally:
    """Counts by key over the slices of a task, of bounded size: with more than `limit` keys the counts so far are given out."""

    def __init__(self, limit: int = 2 << 20, names: tuple[str, ...] = ("n",)):
        self.limit, self.names = limit, names
        self.parts: list[pa.Table] = []
        self.held = 0

    def add(self, keys: pa.Array, *counts: np.ndarray) -> Iterator[pa.Table]:
        """Keys (not necessarily distinct) and their counts; gives tables of key and counts when there are too many."""
        self.parts.append(pa.table([keys, *map(pa.array, counts)], ["key", *self.names]))
        self.held += len(keys)
        if self.held > 2 * self.limit:
            self._merge()
            if self.held > self.limit:
                yield from self.rest()

    def _merge(self) -> None:
        merged = pa.concat_tables(self.parts).group_by("key", use_threads=False).aggregate([(c, "sum") for c in self.names])
        self.parts = [merged.select(["key", *(f"{c}_sum" for c in self.names)]).rename_columns(["key", *self.names])]
        self.held = merged.num_rows

    def rest(self) -> Iterator[pa.Table]:
        if self.parts:
            self._merge()
            yield self.parts[0]
        self.parts, self.held = [], 0


def hot(facts: DataFrame, weight: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of facts (one a key) that hold more than 1/most of the sum of `weight`, at most `most` whatever the data, and the others."""
    total = facts.agg(F.sum(weight).alias("n")).first()["n"] or 0
    is_hot = F.col(weight).cast("decimal(38,0)") * most > F.lit(total).cast("decimal(38,0)")
    return facts.filter(is_hot), facts.filter(~is_hot)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def strings(column: pa.Array) -> pa.Array:
    """A column as large_string without nulls (null is empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


NO_ID = -(1 << 63)


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as int64; a null becomes NO_ID (and an id of that value counts as null)."""
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose text column holds about `limit` bytes; a longer text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = utf8(strings(batch.column(text)))
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            yield batch.slice(i, min(j, n) - i)
            i = min(j, n)
