"""Comparing trees by subtree digests, with moves; and texts by lines.

A directory's digest is a sum, over the files below it, of hashes of their path from there and their
content; sums are combined by task before they are shuffled, so that a directory of any size is one
row. Where both trees have a directory with one digest, nothing below it is compared. A directory
or file that is only in one tree and has its content once in each is a move; what has copies stays
added or removed, since no pairing of them is better than another. Semantics are this project's own.

Lines are aligned by the longest run of lines that are unique in both texts and come in one order,
and so on between them; what is left is cut into hunks. Defined cases: of rows that repeat a path the
greatest digest counts; rows without a path are left out; a null digest equals a null digest. Null
texts are empty; an empty text has no lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ancestors
from ..sources.scratch import Tables, cut

DIGEST = ("d1", "d2", "n_files")


def subtree_digests(files: DataFrame) -> DataFrame:
    """path, d1, d2 and n_files of every directory above the files (path, digest)."""
    up = files.select("path", "digest", F.explode(ancestors(F.col("path"))).alias("dir"))
    below = F.substring("path", F.length("dir") + 2, F.length("path"))
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), below, F.col("digest").isNull(), "digest").cast("decimal(38,0)"))
    return up.groupBy(F.col("dir").alias("path")).agg(wide(1).alias("d1"), wide(2).alias("d2"), F.count("*").alias("n_files"))


def _once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """source and path of what has its keys once on each side."""
    side = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.min("path").alias(name)).filter(f"n_{name} = 1")
    return side(left, "source").join(side(right, "path"), keys).select("source", "path")


def diff_subtrees(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, kind (dir, file), status (same, changed, added, removed, moved), source (of a move) and n_files.

    Directories are given where they are the same or moved as a whole, and only the topmost of them;
    files where no such directory has them.
    """
    with Tables(left.sparkSession, "subtrees") as tables:
        once = lambda d: tables.cut(d.filter("path IS NOT NULL").groupBy("path").agg(F.max("digest").alias("digest")).withColumn("up", F.try_element_at(ancestors(F.col("path")), F.lit(-1))))
        a, b = once(left), once(right)
        da, db = (tables.cut(subtree_digests(d).withColumn("up", F.try_element_at(ancestors(F.col("path")), F.lit(-1)))) for d in (a, b))
        same = tables.cut(da.select("path", "up", *DIGEST).join(db.select("path", *DIGEST), ["path", *DIGEST]))
        # below a directory that is the same all are, so that the one right above tells
        held = same.select(F.col("path").alias("up"))
        top = same.join(held, "up", "left_anti").select("path", F.lit("dir").alias("kind"), F.lit("same").alias("status"), F.lit(None).cast("string").alias("source"), "n_files")
        only = lambda x, y: x.join(y.select("path"), "path", "left_anti")
        moved = tables.cut(_once(only(da, db), only(db, da), list(DIGEST)).join(da.select(F.col("path").alias("source"), F.col("up").alias("source_up"), "n_files"), "source"))
        # the topmost: the directory above did not move along
        along = moved.select(F.col("source").alias("source_up"), F.col("path").alias("to"))
        above = F.regexp_replace("path", r"/[^/]*\z", "")
        heads = tables.cut(moved.join(along, "source_up", "left").filter(F.col("to").isNull() | (above != F.col("to"))).select("path", "source", "n_files"))
        gone = lambda d, c: d.withColumn("one", F.explode(F.concat(ancestors(F.col("path")), F.array("path")))).join(heads.select(F.col(c).alias("one")), "one", "left_semi").select("path").distinct()
        rest = [x.join(held, "up", "left_anti").join(gone(x, c), "path", "left_anti") for x, c in ((a, "source"), (b, "path"))]
        x, y = (tables.cut(r.select("path", "digest")) for r in rest)
        pair = x.select("path", F.col("digest").alias("p"), F.lit(True).alias("in_x")).join(y.select("path", F.col("digest").alias("q"), F.lit(True).alias("in_y")), "path", "full_outer")
        status = F.when(F.col("in_x").isNull(), "added").when(F.col("in_y").isNull(), "removed").when(F.col("p").eqNullSafe(F.col("q")), "same").otherwise("changed")
        files = tables.cut(pair.select("path", F.coalesce("p", "q").alias("digest"), status.alias("status")))
        pairs = tables.cut(_once(files.filter("status = 'removed' AND digest IS NOT NULL"), files.filter("status = 'added' AND digest IS NOT NULL"), ["digest"]))
        plain = files.join(pairs.select(F.col("source").alias("path")).unionByName(pairs.select("path")), "path", "left_anti")
        shape = lambda d, kind, status, source, n: d.select("path", F.lit(kind).alias("kind"), status.alias("status"), source.alias("source"), n.cast("long").alias("n_files"))
        none, one = F.lit(None).cast("string"), F.lit(1)
        out = top.unionByName(shape(heads, "dir", F.lit("moved"), F.col("source"), F.col("n_files"))).unionByName(shape(pairs, "file", F.lit("moved"), F.col("source"), one)).unionByName(shape(plain, "file", F.col("status"), none, one))
        return cut(out)


def anchors(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of the longest run of lines that are unique in both and ascend in both."""
    n, m = Counter(left), Counter(right)
    where = {s: j for j, s in enumerate(right) if m[s] == 1}
    pairs = [(i, where[s]) for i, s in enumerate(left) if n[s] == 1 and s in where]
    tops: list[int] = []  # least last place of an ascending run of each length
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
    run, k = [], last[-1] if last else -1
    while k >= 0:
        run.append(pairs[k])
        k = back[k]
    return run[::-1]


def hunks(left: list[str], right: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(left start, left end, right start, right end) of all differences, from 0, ends exclusive."""
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
        if a == b and c == d:
            continue
        run = anchors(left[a:b], right[c:d]) if a < b and c < d else []
        if not run:
            yield a, b, c, d
            continue
        places = [(a - 1, c - 1), *((a + i, c + j) for i, j in run), (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(places, places[1:], strict=False)][::-1]


def diff_lines(pairs: DataFrame, id_col: str = "name") -> DataFrame:
    """name, hunk (from 0), left_start, right_start (from 0), removed and added lines of pairs (name, left, right of text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                left, right = ((b.column(c)[i].as_py() or "").split("\n") for c in ("left", "right"))
                left, right = ([] if x == [""] else x for x in (left, right))
                found = list(hunks(left, right))
                if found:
                    names = b.column("name").slice(i, 1).take(pa.array([0] * len(found), pa.int32()))
                    lines = pa.list_(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(range(len(found)), pa.int32()), pa.array([h[0] for h in found], pa.int32()), pa.array([h[2] for h in found], pa.int32()), pa.array([left[h[0] : h[1]] for h in found], lines), pa.array([right[h[2] : h[3]] for h in found], lines)],
                        schema.names,
                    )

    schema = T.StructType([T.StructField("name", pairs.schema[id_col].dataType), *T.StructType.fromDDL("hunk int, left_start int, right_start int, removed array<string>, added array<string>").fields])
    return pairs.select(F.col(id_col).alias("name"), "left", "right").mapInArrow(run, schema)


def extract_prompts(conversations: DataFrame, role: str = "system") -> DataFrame:
    """conv_id and prompt: the texts of one role (null ones are empty), in order, as one text; without any there is no row."""
    mine = conversations.filter((F.col("role") == role) & F.col("conv_id").isNotNull())
    return mine.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))["text"], "\n").alias("prompt"))
