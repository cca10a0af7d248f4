"""Outline trees (OPML and FreeMind) as edge lists, and as Markdown."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, node string, parent string, depth int, title string"


def outline_nodes(text: str) -> list[tuple[str, str | None, int, str]]:
    """(node, parent, depth, title) in document order; nodes are numbered along their path, as 1.2.1."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("outlines with a document type are not read")
    root = ET.fromstring(text)  # noqa: S314
    top, tag, name = (root.find("body"), "outline", "text") if root.tag == "opml" else (root, "node", "TEXT")
    out: list[tuple[str, str | None, int, str]] = []
    stack = [(child, f"{i}", None, 0) for i, child in reversed(list(enumerate(top.findall(tag) if top is not None else [], 1)))]
    while stack:
        element, node, parent, depth = stack.pop()
        out.append((node, parent, depth, element.get(name) or element.get("title") or ""))
        stack += [(child, f"{node}.{i}", node, depth + 1) for i, child in reversed(list(enumerate(element.findall(tag), 1)))]
    return out


def read_outlines(documents: DataFrame) -> DataFrame:
    """Edge list of outline documents (path, text); documents that are not outlines give no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    rows += [(path, *n) for n in outline_nodes(text or "")]
                except (ET.ParseError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "node", "parent", "depth", "title"])

    return documents.select("path", "text").mapInPandas(run, SCHEMA)


def outline_markdown(nodes: DataFrame) -> DataFrame:
    """path and Markdown text: a heading for top nodes, nested list items below."""
    line = F.when(F.col("depth") == 0, F.concat(F.lit("# "), "title")).otherwise(F.concat(F.expr("repeat('  ', depth - 1)"), F.lit("- "), F.col("title")))
    order = F.transform(F.split("node", r"\."), lambda x: x.cast("int"))
    lines = nodes.select("path", F.struct(order.alias("order"), line.alias("line")).alias("x"))
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("markdown"))
