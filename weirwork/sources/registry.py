"""Latest published versions: a snapshot table, or a bounded number of parallel lookups."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_component

WORKERS = 16  # lookups under way at once


def fetch_json(url: str) -> tuple[int, str | None]:
    """HTTP status and the text of field version, if it is text; network errors end the run."""
    try:
        with urllib.request.urlopen(url, timeout=30) as reply:  # noqa: S310
            version = json.loads(reply.read()).get("version")
            return reply.status, version if isinstance(version, str) else None
    except urllib.error.HTTPError as e:
        return e.code, None


def lookup_latest(declarations: DataFrame, base: str, fetch: Callable[[str], tuple[int, str | None]] = fetch_json, workers: int = WORKERS) -> DataFrame:
    """name, http_status and version: one lookup a distinct name, whatever the number of declarations."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [fetch(u) for u in part["url"]]
            yield pd.DataFrame({"name": part["name"], "http_status": [s for s, _ in found], "version": [v for _, v in found]})

    names = declarations.select("name").distinct().select("name", F.concat(F.lit(base.rstrip("/") + "/"), encode_component(F.col("name")), F.lit("/latest")).alias("url"))
    return names.repartition(workers).mapInPandas(run, "name string, http_status int, version string")
