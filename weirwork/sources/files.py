"""File sources: JSON manifests, YAML and Markdown documents, directory listings, raw bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ancestors, frontmatter
from ..functions.yaml12 import yaml_to_json
from ..schemas import DIR_ENTRY, MANIFEST
from .scratch import remove

PRUNED = ("node_modules", ".git", "dist")
SHARED = "_assets"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, relative ones below the working directory."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def below(path: Column, root: str) -> Column:
    """Paths as Spark's readers give them, relative to a qualified root; what is not below it stays whole."""
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    top = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(top)), F.substring(plain, len(top) + 1, 1 << 30)).otherwise(plain)


def _at(root: str, globs: Iterable[str]) -> list[str]:
    return [g if "://" in g or g.startswith(("/", "file:")) else f"{root.rstrip('/')}/{g}" for g in globs]


def read_manifests(spark: SparkSession, *globs: str, root: str = ".") -> DataFrame:
    """manifest (path relative to the root, which globs are relative to too) and its three version maps, by a declared schema.

    Explicit globs reach dot-directories. The root's own manifest is named as dependencies.ROOT says.
    """
    top = qualified(spark, root)
    found = spark.read.schema(MANIFEST).json(_at(top, globs), multiLine=True)
    return found.select(below(F.col("_metadata.file_path"), top).alias("manifest"), "dependencies", "devDependencies", "overrides")


def read_documents(spark: SparkSession, *globs: str) -> DataFrame:
    """path and whole text of each file."""
    return spark.read.text(list(globs), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_yaml(spark: SparkSession, *globs: str) -> DataFrame:
    """path, document (VARIANT) and error of each YAML file."""
    parsed = read_documents(spark, *globs).withColumn("yaml", yaml_to_json(F.col("text")))
    return parsed.select("path", F.parse_json("yaml.json").alias("document"), F.col("yaml.error").alias("error"))


def read_frontmatter(docs: DataFrame) -> DataFrame:
    """path, name and description (VARIANT) and error of documents (path, text)."""
    parsed = docs.select("path", frontmatter(F.col("text")).alias("block")).withColumn("yaml", yaml_to_json(F.col("block")))
    document = F.parse_json("yaml.json")
    error = F.when(F.col("block").isNull(), "no frontmatter").otherwise(F.col("yaml.error"))
    return parsed.select("path", F.try_variant_get(document, "$.name", "variant").alias("name"), F.try_variant_get(document, "$.description", "variant").alias("description"), error.alias("error"))


def _kind(path: str) -> str:
    """file, dir, other, link, or dirlink for a link to a directory."""
    if os.path.islink(path):
        return "dirlink" if os.path.isdir(path) else "link"
    return "dir" if os.path.isdir(path) else "file" if os.path.isfile(path) else "other"


def walk(root: str, tier: str, top: str, prune: Iterable[str] = PRUNED) -> Iterator[tuple[str, str, str, str]]:
    """(tier, path below the root, name, kind) of one entry of a tier and of everything below it; links are not followed.

    Pruned folders are left out below a unit only: a unit may have such a name, and in the shared
    folder everything counts.
    """
    skip = () if top == SHARED else tuple(prune)
    stack = [top]
    while stack:
        here = stack.pop()
        kind = _kind(os.path.join(root, here))
        yield tier, here, here.rsplit("/", 1)[-1], kind
        if kind == "dir":
            stack += [f"{here}/{name}" for name in sorted(os.listdir(os.path.join(root, here)), reverse=True) if name not in skip]


def list_tiers(spark: SparkSession, root: str, tiers: Iterable[str], prefix: str = ".", prune: Iterable[str] = PRUNED) -> tuple[DataFrame, DataFrame]:
    """Tiers (tier, ordinal, present, kind) and all entries of those that are there.

    The driver only looks at the tiers and their direct entries; each of these is walked by a task,
    so what it holds is one row a unit. The folder must be one that all executors share.
    """
    known, tops = [], []
    for i, tier in enumerate(tiers):
        path = os.path.join(root, prefix + tier)
        there = os.path.lexists(path)
        kind = ("link" if os.path.islink(path) else "dir" if os.path.isdir(path) else "other") if there else None
        known.append((tier, i, there, kind))
        if kind == "dir":
            tops += [(tier, path, name) for name in os.listdir(path)]
    skip = tuple(prune)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tier, path, name in part.itertuples(index=False):
                yield pd.DataFrame(list(walk(path, tier, name, skip)), columns=["tier", "path", "name", "kind"])

    listed = spark.createDataFrame(tops, "tier string, root string, name string").repartition(max(1, min(len(tops), spark.sparkContext.defaultParallelism * 4)), "tier", "name")
    return spark.createDataFrame(known, "tier string, ordinal int, present boolean, kind string"), listed.mapInPandas(run, DIR_ENTRY)


def list_store(spark: SparkSession, root: str, tiers: Iterable[str], prefix: str = ".", prune: Iterable[str] = PRUNED) -> tuple[DataFrame, DataFrame]:
    """The same as list_tiers for any store that Spark reads, mounted or not.

    The driver asks the Hadoop file system for the tiers and their direct entries; what lies below
    the entries is listed by Spark's own reader, in a job of its own where there are many folders
    (the driver holds that list, as it does for any read), and no content is read. A store knows files: directories are those above some file, links are taken for
    what they lead to, and as in all of Spark's listings names that begin with a dot or an underscore
    are passed over below a tier's direct entries.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = qualified(spark, root).rstrip("/")
    fs = hadoop.Path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    known, direct = [], []
    for i, tier in enumerate(tiers):
        path = hadoop.Path(f"{top}/{prefix}{tier}")
        there = fs.exists(path)
        kind = ("dir" if fs.getFileStatus(path).isDirectory() else "other") if there else None
        known.append((tier, i, there, kind))
        if kind == "dir":
            direct += [(tier, s.getPath().getName(), "dir" if s.isDirectory() else "file") for s in fs.listStatus(path)]
    entries = spark.createDataFrame([(t, n, n, k) for t, n, k in direct], DIR_ENTRY)
    folders = [f"{top}/{prefix}{t}/{n}" for t, n, k in direct if k == "dir"]
    if folders:
        escaped = [re.sub(r"([\\[\]{}*?])", r"\\\1", f) for f in folders]  # names, not patterns
        # the reader's own list, as its rows leave out empty files
        held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(escaped).inputFiles()
        found = spark.createDataFrame([(f,) for f in held], "file string").select(below(F.col("file"), top).alias("whole"))
        files = found.select(F.substring(F.regexp_extract("whole", "^[^/]*", 0), len(prefix) + 1, 1 << 30).alias("tier"), F.regexp_replace("whole", "^[^/]*/", "").alias("path"))
        parts = F.slice(F.split("path", "/"), 2, 1 << 30)
        shared = F.startswith("path", F.lit(SHARED + "/"))
        kept = files.filter(shared | ~F.arrays_overlap(parts, F.array(*map(F.lit, prune)).cast("array<string>")))
        rows = kept.select("tier", "path", F.lit("file").alias("kind")).unionByName(kept.select("tier", F.explode(ancestors(F.col("path"))).alias("path"), F.lit("dir").alias("kind")).filter(F.contains("path", F.lit("/"))).distinct())
        entries = entries.unionByName(rows.select("tier", "path", F.regexp_extract("path", r"[^/]*\z", 0).alias("name"), "kind"))
    return spark.createDataFrame(known, "tier string, ordinal int, present boolean, kind string"), entries


def read_bytes(spark: SparkSession, *globs: str) -> DataFrame:
    """path, size and content of each file."""
    return spark.read.format("binaryFile").load(list(globs)).select("path", F.col("length").alias("size"), "content")


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + re.sub("^file:/+", "/", folder))


def _direct(spark: SparkSession, folder: str) -> DataFrame:
    """The direct entries of a folder (columns folder and entry), a partition each up to a thousand."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    return spark.createDataFrame([(folder, n) for n in names], "folder string, entry string").repartition(max(1, min(len(names), 1000)), "entry")


def read_heads(spark: SparkSession, folder: str, n: int = 16) -> DataFrame:
    """path (below the folder), size and content (the first n bytes) of every file below a folder.

    Made for very many small files: the driver lists the folder's direct entries only, and each of
    these is walked and read by a task, a folder at a time, so that no list of all files is anywhere.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for top, entry in zip(part.column("folder").to_pylist(), part.column("entry").to_pylist(), strict=True):
                store, root = _store(top)
                todo = [f"{root}/{entry}"]
                while todo:
                    here = todo.pop()
                    info = store.get_file_info(here)
                    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(here)) if info.type == pafs.FileType.Directory else []
                    todo += [f.path for f in found if f.type == pafs.FileType.Directory]
                    held = [f for f in found if f.is_file]
                    for at in range(0, len(held), 4096):
                        some, heads = held[at : at + 4096], []
                        for f in some:
                            with store.open_input_file(f.path) as opened:
                                heads.append(opened.read(n))
                        yield pa.RecordBatch.from_arrays([pa.array([f.path[len(root) + 1 :] for f in some]), pa.array([f.size for f in some], pa.int64()), pa.array(heads, pa.binary())], ["path", "size", "content"])

    return _direct(spark, folder).mapInArrow(run, "path string, size long, content binary")


def remove_below(spark: SparkSession, folder: str) -> None:
    """Remove a folder of very many files: its direct folders by tasks, then the rest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for top, entry in zip(part.column("folder").to_pylist(), part.column("entry").to_pylist(), strict=True):
                store, root = _store(top)
                if store.get_file_info(f"{root}/{entry}").type == pafs.FileType.Directory:
                    store.delete_dir(f"{root}/{entry}")
            yield part

    _direct(spark, folder).mapInArrow(run, "folder string, entry string").count()
    remove(spark, folder)
