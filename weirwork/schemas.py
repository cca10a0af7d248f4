"""Schemas of the tables that the catalogue operators take and give."""

from __future__ import annotations

from pyspark.sql import types as T

_versions = T.MapType(T.StringType(), T.StringType())


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: As read from package manifests: one field a section, never one a package.
MANIFEST = T.StructType([T.StructField(n, _versions) for n in ("dependencies", "devDependencies", "overrides")])
DECLARATION = _strings("manifest", "name", "spec", "version")
LATEST = T.StructType([T.StructField("name", T.StringType()), T.StructField("http_status", T.IntegerType()), T.StructField("version", T.StringType())])
DIR_ENTRY = _strings("tier", "path", "name", "kind")  # kind: file, dir, link, dirlink (a link to a directory), other
