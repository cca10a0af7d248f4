"""YAML as JSON text: core-schema scalars (no/on/012 stay what they look like) and no repeated keys."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Loader(yaml.SafeLoader):
    """Resolves only the scalars of the core schema."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789"),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


def _integer(loader: _Loader, node: yaml.Node) -> int:
    text = loader.construct_scalar(node)
    return int(text, 8 if text.startswith("0o") else 16 if text.startswith("0x") else 10) if not text.startswith("0o") else int(text[2:], 8)


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    out: dict = {}
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        key = key if isinstance(key, str) else json.dumps(key)
        if key in out:
            raise yaml.constructor.ConstructorError(None, None, f"repeated key {key}", key_node.start_mark)
        out[key] = loader.construct_object(value_node, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:int", _integer)
_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def _plain(value):
    """Infinite numbers and nan as null, as JSON writers give them."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def to_json(text: str | None) -> tuple[str | None, str | None]:
    """The document as JSON text, and the error if it is not one document of YAML."""
    if text is None:
        return None, None
    try:
        return json.dumps(_plain(yaml.load(text, Loader=_Loader)), ensure_ascii=False, allow_nan=False), None  # noqa: S506
    except (yaml.YAMLError, ValueError, TypeError) as e:
        return None, str(e).split("\n")[0]


def yaml_to_json(text: Column) -> Column:
    """struct(json, error) of each text; parse_json gives a VARIANT from it."""

    @F.pandas_udf("json string, error string")
    def parse(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([to_json(x) for x in part], columns=["json", "error"])

    return parse(text)
