"""Documents taken apart into a tree of components.

Lines of Markdown become headings, paragraphs, lists, quotes, tables and code; consecutive lines of
one kind are one component. The fold over a document's lines keeps a stack of open headings: the
parent of a heading is the last one above it of a lower level, that of anything else the last
heading. Headings are numbered among their siblings, so that a skipped level leaves no gap; `path` is
the titles from the root down. Semantics are this project's own.

Defined cases: a null or empty text has no components; blank lines end a component; a code block that
is not closed ends with the text. Ids may have any type; rows without one are taken apart too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*\Z")
KINDS: Sequence[tuple[str, re.Pattern[str]]] = (("list", re.compile(r"[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]")), ("quote", re.compile(r"[ \t]*>")), ("table", re.compile(r"[ \t]*\|")))
FENCE = re.compile(r"[ \t]*(```+|~~~+)")
COLUMNS = "component int, kind string, level int, number string, parent int, path string, text string"


def take_apart(text: str) -> Iterator[tuple[int, str, int, str, int | None, str, str]]:
    """(component, kind, level, number, parent, path, text) in the order of the text; level 0 for what is no heading."""
    stack: list[tuple[int, int, str, str, int]] = []  # level, component, number, path, children
    roots = n = 0
    kind, lines, fence = "", [], None

    def flush() -> Iterator[tuple]:
        nonlocal n, lines
        if lines:
            top = stack[-1] if stack else None
            yield n, kind, 0, top[2] if top else "", top[1] if top else None, top[3] if top else "", "\n".join(lines)
            n, lines = n + 1, []

    for line in text.split("\n"):
        mark = FENCE.match(line)
        if fence:
            lines.append(line)
            if mark and mark.group(1).startswith(fence):
                yield from flush()
                fence = None
            continue
        if mark:
            yield from flush()
            kind, lines, fence = "code", [line], mark.group(1)
            continue
        head = HEADING.match(line)
        if head:
            yield from flush()
            level, title = len(head.group(1)), head.group(2)
            while stack and stack[-1][0] >= level:
                stack.pop()
            if stack:
                up = stack[-1]
                stack[-1] = (*up[:4], up[4] + 1)
                number, parent, path = f"{up[2]}.{up[4] + 1}", up[1], f"{up[3]} / {title}"
            else:
                roots += 1
                number, parent, path = str(roots), None, title
            yield n, "heading", level, number, parent, path, title
            stack.append((level, n, number, path, 0))
            n += 1
            continue
        if not line.strip():
            yield from flush()
            continue
        here = next((k for k, p in KINDS if p.match(line)), "paragraph")
        if here != kind:
            yield from flush()
        kind = here
        lines.append(line)
    yield from flush()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component (from 0), kind, level, number and path of the section, parent and text of every component."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(COLUMNS).fields])
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(take_apart(b.column("text")[i].as_py() or ""))
                if rows:
                    ids = pa.array([0] * len(rows), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1).take(ids), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], schema.names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def of_kinds(found: DataFrame, kinds: Iterable[str], section: str | None = None) -> DataFrame:
    """The components of some kinds, of all sections or of the one of a number and those below it."""
    rows = found.filter(F.col("kind").isin(list(kinds)))
    return rows if section is None else rows.filter((F.col("number") == section) | F.startswith(F.col("number"), F.lit(section + ".")))


def contents(found: DataFrame) -> DataFrame:
    """doc_id, number, level, title, path and what each section holds itself: components and characters by kind."""
    heads = found.filter("kind = 'heading'").select("doc_id", F.col("component").alias("parent"), "number", "level", F.col("text").alias("title"), "path")
    held = found.filter("kind <> 'heading' AND parent IS NOT NULL").groupBy("doc_id", "parent").agg(F.count("*").alias("components"), F.sum(F.length("text")).alias("chars"))
    joined = heads.join(held, [heads["doc_id"].eqNullSafe(held["doc_id"]), heads["parent"] == held["parent"]], "left")
    return joined.select(heads["doc_id"], "number", "level", "title", "path", F.coalesce("components", F.lit(0)).alias("components"), F.coalesce("chars", F.lit(0)).alias("chars"))
