"""Versions, identifiers, paths, URL parts and type guards as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose meaning the results depend on. \z, as $ would also match before a final newline.
VERSION = r"^\^?(\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?)\z"
IDENTIFIER = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
FRONTMATTER = r"^---\s*\n([\s\S]*?)\n---(?:\s*\n|\z)"


def parse_version(spec: Column) -> Column:
    """The exact version of a plain or caret spec; null for every other spec."""
    return F.nullif(F.regexp_extract(spec, VERSION, 1), F.lit(""))


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(IDENTIFIER), F.lit(False))


def frontmatter(text: Column) -> Column:
    """The block between the leading --- lines; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, FRONTMATTER, 1), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path: 'a/b/c' has 'a' and 'a/b'."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def encode_component(text: Column) -> Column:
    """Percent-encoding of a URL component: unlike form encoding, a blank is %20 and !'()* stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def variant_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null of a VARIANT; null for no value."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.isNotNull(), "number")
    )


def is_object(value: Column) -> Column:
    return F.coalesce(variant_kind(value) == "object", F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(variant_kind(value) == "string", F.lit(False))


def filled(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def is_markdown(path: Column) -> Column:
    return F.coalesce(F.endswith(path, F.lit(".md")), F.lit(False))
