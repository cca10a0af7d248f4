"""The cluster's shared folder, for lineage cuts and intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one only on a single machine where none is set; a cluster without it is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = sc.getCheckpointDir()
        if where is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="weirwork-"))
            where = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and continue from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/weirwork-{name}-{uuid.uuid4().hex}"


class Tables:
    """Intermediate tables of one computation, below the shared folder; they go when it ends.

    Unlike a checkpoint, which keeps the estimates of the plan behind it (they multiply join by join,
    without bound in a loop), a written table has its real size, and is read by columns.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, name), 0
        self.paths: dict[int, str] = {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and continue from the files."""
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, table: DataFrame) -> None:
        """Remove a table that this has written, before the computation ends."""
        remove(self.spark, self.paths.pop(id(table)))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
