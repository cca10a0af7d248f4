"""Where a configuration field's value comes from. Precedence is this project's own.

A field has a type, maybe a default and, for a choice, options; a selection is what a user set. In
this order: Unresolved where the value names a variable (`${NAME}`) that is not given, or a choice that
is no option; Empty where there is neither a selection nor a default, or an empty text is selected;
Selected where a selection is there, also one that equals the default; Default else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIABLE = r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}"


def provenance(fields: DataFrame, selections: DataFrame, variables: DataFrame) -> DataFrame:
    """key, value (with variables put in) and badge of every field.

    fields: key, type, default, options (array). selections: key, value, at most one a key (of several
    the greatest counts). variables: name, value, of which the fields' own are looked up by a join.
    """
    chosen = selections.groupBy("key").agg(F.max("value").alias("chosen"))
    raw = fields.join(chosen, "key", "left").withColumn("raw", F.coalesce("chosen", "default"))
    names = F.array_distinct(F.regexp_extract_all("raw", F.lit(VARIABLE), 1))
    uses = raw.select("key", F.explode(names).alias("name")).join(variables.groupBy("name").agg(F.max("value").alias("given")), "name", "left")
    known = uses.groupBy("key").agg(F.count_if(F.col("given").isNull()).alias("open"), F.collect_list(F.when(F.col("given").isNotNull(), F.struct("name", "given"))).alias("given"))
    put = F.aggregate("given", F.col("raw"), lambda s, v: F.replace(s, F.concat(F.lit("${"), v["name"], F.lit("}")), v["given"]))
    all_ = raw.join(known, "key", "left").withColumn("value", F.when(F.col("given").isNotNull(), put).otherwise(F.col("raw")))
    no_option = (F.col("type") == "select") & (F.col("value") != "") & ~F.array_contains(F.coalesce("options", F.array().cast("array<string>")), F.col("value"))
    badge = F.when((F.col("open") > 0) | no_option, "Unresolved").when(F.col("value").isNull() | (F.col("value") == ""), "Empty").when(F.col("chosen").isNotNull(), "Selected").otherwise("Default")
    return all_.select("key", "value", badge.alias("badge"))
