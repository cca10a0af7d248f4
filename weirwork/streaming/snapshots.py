"""A block index kept in segments: documents are added, changed and deleted, and readers see one snapshot.

Folder: `segment=<n>/` with `blocks`, `ranges` and `dead`, and `snapshot-<n>.json`, which lists the
segments of snapshot n. A commit writes a new segment: the blocks of new and changed documents, and
as `dead` the places, in older segments, of documents that are changed or deleted. Then the list is
written under another name and renamed, which fails where that snapshot exists: readers open the
newest list and see a commit wholly or not at all, and of two writers from one snapshot the second
gets an error. Files of older snapshots stay until `vacuum`.

Segments are merged by tiers: FAN segments of one size class become one, without their dead
documents. A new range is repacked by one task from its old ranges' blocks; texts are not read again.

Defined cases: of rows with one id in a commit the greatest text counts. A document whose text is the
one that is indexed is left alone. An id both added and deleted in a commit is deleted. Deleting what
is not there does nothing. Rows without an id are left out. A commit without changes makes no snapshot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.block_index import BLOCKS, BUILT, RANGE_DOCS, RANGES, Index, build, by_term, repack, split
from ..sources.scratch import Tables

FAN = 4
RANGE_TOKENS = 1 << 20  # of a merged range, besides those of its last old range
DEAD = "segment long, range long, gone array<int>, lens array<int>"


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, range_docs: int = RANGE_DOCS):
        self.spark, self.folder, self.range_docs = spark, folder.rstrip("/"), range_docs
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def current(self) -> dict:
        """The newest snapshot: number and segments (number, documents when it was written)."""
        if not self._fs.exists(self._hadoop.Path(self.folder)):
            return {"snapshot": 0, "segments": [], "next": 0, "batch": None}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(self.folder))]
        numbers = [int(n[9:-5]) for n in names if n.startswith("snapshot-") and n.endswith(".json")]
        if not numbers:
            return {"snapshot": 0, "segments": [], "next": 0, "batch": None}
        stream = self._fs.open(self._path(f"snapshot-{max(numbers):09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        draft, name = self._path(f".draft-{uuid.uuid4().hex}"), self._path(f"snapshot-{state['snapshot']:09d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has made snapshot {state['snapshot']}")

    def _read(self, name: str, schema: str, state: dict) -> DataFrame:
        """Rows of the snapshot's segments; ranges are numbered within a segment, so `segment` belongs to their key."""
        paths = [f"{self.folder}/segment={s['segment']}/{name}" for s in state["segments"] if name != "dead" or s["kills"]]
        if not paths:
            return self.spark.createDataFrame([], schema if name == "dead" else f"segment long, {schema}")
        rows = self.spark.read.schema(schema)
        if name == "dead":
            alive = [s["segment"] for s in state["segments"]]
            return rows.parquet(*paths).filter(F.col("segment").isin(alive))
        return rows.option("basePath", self.folder).schema(f"{schema}, segment long").parquet(*paths)

    def _dead(self, state: dict) -> DataFrame:
        """One row a range with dead documents."""
        rows = self._read("dead", DEAD, state).groupBy("segment", "range").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.flatten(F.collect_list("lens")).alias("lens"))
        total = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
        return rows.select("segment", "range", "gone", F.size("gone").cast("long").alias("n_gone"), total.alias("total_gone"))

    @staticmethod
    def _keyed(rows: DataFrame) -> DataFrame:
        """One number for segment and range: ranges have the task in the upper half and stay below 2^44."""
        return rows.withColumn("range", F.shiftleft("segment", 44).bitwiseOR(F.col("range"))).drop("segment")

    def open(self, state: dict | None = None) -> Index:
        """The newest snapshot, or the given one, to search in."""
        state = state or self.current()
        return Index(self._keyed(self._read("blocks", BLOCKS, state)), self._keyed(self._read("ranges", RANGES, state)), self._keyed(self._dead(state)))

    def documents(self, state: dict | None = None) -> DataFrame:
        """doc_id, segment, range, ord, len and version of the live documents."""
        state = state or self.current()
        every = self._read("ranges", RANGES, state).select("segment", "range", F.posexplode(F.arrays_zip("ids", "lens", "versions")).alias("ord", "x"))
        gone = self._dead(state).select("segment", "range", F.explode("gone").alias("ord"))
        return every.join(gone, ["segment", "range", "ord"], "left_anti").select(F.col("x.ids").alias("doc_id"), "segment", "range", "ord", F.col("x.lens").alias("len"), F.col("x.versions").alias("version"))

    def _write(self, number: int, blocks: DataFrame, ranges: DataFrame, dead: DataFrame | None) -> dict:
        top = f"{self.folder}/segment={number}"
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        by_term(blocks, parts).write.mode("overwrite").parquet(f"{top}/blocks")
        ranges.write.mode("overwrite").parquet(f"{top}/ranges")
        kills = False
        if dead is not None:
            dead.write.mode("overwrite").parquet(f"{top}/dead")
            kills = not self.spark.read.schema(DEAD).parquet(f"{top}/dead").isEmpty()
        n = self.spark.read.schema(RANGES).parquet(f"{top}/ranges").agg(F.sum("n").alias("n")).first()["n"] or 0
        return {"segment": number, "docs": n, "kills": kills}

    def commit(self, added: DataFrame | None = None, deleted: DataFrame | None = None, batch: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Add or change the documents of `added`, delete those whose id is in `deleted`. Returns the snapshot.

        batch: the number of a stream's batch; one that is not above the last committed changes nothing.
        """
        state = self.current()
        if batch is not None and state["batch"] is not None and batch <= state["batch"]:
            return state["snapshot"]
        none = self.spark.createDataFrame([], "doc_id long")
        gone = none if deleted is None else deleted.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        with Tables(self.spark, "commit") as tables:
            gone = tables.cut(gone)
            live = self.documents(state)
            if added is None:
                fresh = self.spark.createDataFrame([], "doc_id long, text string, version string")
            else:
                text = F.coalesce(F.col(text_col), F.lit(""))
                last = added.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(text).alias("text")).withColumn("version", F.md5(F.col("text").cast("binary")))
                fresh = last.join(gone, "doc_id", "left_anti").join(live.select("doc_id", "version"), ["doc_id", "version"], "left_anti")
            fresh = tables.cut(fresh)
            replaced = live.join(fresh.select("doc_id").unionByName(gone).distinct(), "doc_id", "left_semi")
            dead = tables.cut(replaced.groupBy("segment", "range").agg(F.collect_list("ord").alias("gone"), F.collect_list("len").alias("lens")))
            if fresh.isEmpty() and dead.isEmpty():
                return state["snapshot"]
            blocks, ranges = split(tables.cut(build(fresh, self.range_docs)))
            made = self._write(state["next"], blocks, ranges, dead)
        state = {"snapshot": state["snapshot"] + 1, "segments": [*state["segments"], made], "next": state["next"] + 1, "batch": state["batch"] if batch is None else batch}
        self._publish(state)
        return state["snapshot"]

    def merge(self, every: bool = False) -> int:
        """Merge the first FAN segments of one size class (powers of FAN), or all segments. Returns the snapshot."""
        state = self.current()
        chosen = [s["segment"] for s in state["segments"]] if every else self._tier(state)
        if not chosen:
            return state["snapshot"]
        mine = F.col("segment").isin(chosen)
        with Tables(self.spark, "merge") as tables:
            live = tables.cut(self.documents(state).filter(mine))
            counts = live.groupBy("segment", "range").agg(F.count("*").alias("n"), F.sum(F.col("len").cast("long")).alias("tokens"))
            # old ranges in order fill new ones, by documents and by tokens; a row an old range, some thousandths of the documents
            before = Window.orderBy("segment", "range").rowsBetween(Window.unboundedPreceding, -1)
            base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
            target = tables.cut(counts.select("segment", "range", base("n").alias("docs"), base("tokens").alias("tokens")).select("segment", "range", F.expr(f"docs div {self.range_docs} + tokens div {RANGE_TOKENS}").alias("new")))
            # each new range is repacked by one task from the blocks of its old ones
            old = self._read("blocks", BLOCKS, state).filter(mine).join(target, ["segment", "range"]).select("new", "segment", "range", "term", "ords", "tfs", "positions")
            docs = live.join(target.withColumnRenamed("new", "into"), ["segment", "range"]).select("into", "segment", "range", "ord", "doc_id", "len", "version")
            blocks, ranges = split(tables.cut(old.groupBy("new").cogroup(docs.groupBy("into")).applyInArrow(repack, BUILT)))
            others = [s["segment"] for s in state["segments"] if s["segment"] not in chosen]
            # what the merged segments say about others stays
            made = self._write(state["next"], blocks, ranges, self._all_dead(state, chosen, others) if others else None)
        segments = [s for s in state["segments"] if s["segment"] not in chosen]
        state = {"snapshot": state["snapshot"] + 1, "segments": [made, *segments] if not others else [*segments, made], "next": state["next"] + 1, "batch": state["batch"]}
        self._publish(state)
        return state["snapshot"]

    def _all_dead(self, state: dict, chosen: list[int], others: list[int]) -> DataFrame:
        """The dead places in other segments that the chosen ones name."""
        naming = [f"{self.folder}/segment={s['segment']}/dead" for s in state["segments"] if s["segment"] in chosen and s["kills"]]
        if not naming:
            return self.spark.createDataFrame([], DEAD)
        return self.spark.read.schema(DEAD).parquet(*naming).filter(F.col("segment").isin(others))

    def _tier(self, state: dict) -> list[int]:
        classes: dict[int, list[int]] = {}
        for s in state["segments"]:
            level, size = 0, s["docs"]
            while size >= FAN:
                level, size = level + 1, size // FAN
            classes.setdefault(level, []).append(s["segment"])
        return next((x[:FAN] for _, x in sorted(classes.items()) if len(x) >= FAN), [])

    def vacuum(self) -> None:
        """Remove what the newest snapshot does not name: readers of older ones must be done."""
        state = self.current()
        keep = {f"segment={s['segment']}" for s in state["segments"]} | {f"snapshot-{state['snapshot']:09d}.json"}
        for s in self._fs.listStatus(self._hadoop.Path(self.folder)):
            if s.getPath().getName() not in keep:
                self._fs.delete(s.getPath(), True)

    def stats(self) -> DataFrame:
        """One row about the live index: snapshot, segments, documents, terms, postings and occurrences."""
        state = self.current()
        live = self.documents(state).agg(F.count("*").alias("documents"))
        blocks, dead = self._read("blocks", BLOCKS, state), self._dead(state).select("segment", "range", "gone")
        left = blocks.join(dead, ["segment", "range"], "left").select("term", F.arrays_zip("ords", "tfs").alias("p"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
        left = left.select("term", F.filter("p", lambda x: ~F.array_contains("gone", x["ords"])).alias("p"))
        per = left.groupBy("term").agg(F.sum(F.size("p")).alias("postings"), F.sum(F.aggregate("p.tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("occurrences")).filter("postings > 0")
        terms = per.agg(F.count("*").alias("terms"), F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))
        about = F.struct(F.lit(state["snapshot"]).alias("snapshot"), F.lit(len(state["segments"])).alias("segments"))
        return live.crossJoin(terms).withColumn("about", about).select("about.*", "documents", "terms", "postings", "occurrences")  # a row each

    def stream(self, docs: DataFrame, checkpoint: str, delete_col: str | None = None) -> StreamingQuery:
        """Keep the index up to date with a stream of documents; rows whose delete_col is true delete theirs."""

        def take(batch: DataFrame, number: int) -> None:
            if delete_col is None:
                self.commit(batch, None, number)
            else:
                self.commit(batch.filter(~F.coalesce(F.col(delete_col), F.lit(False))), batch.filter(delete_col), number)
            self.merge()

        return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
