"""Redaction of JSON documents of any depth, level by level.

Texts are parsed to variants and opened one level at a time: values under a sensitive key are
replaced whole, strings lose their secrets, objects and arrays are opened further. Then the
levels are put together from the bottom. Every step is a distributed plan over all documents,
and a document is never more than its own nodes. Levels are kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.session import cut_lineage

MARK = '"[REDACTED]"'


def quoted(text: Column) -> Column:
    """``text`` as a JSON string."""
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _described(nodes: DataFrame) -> DataFrame:
    """Nodes with their kind and, for leaves, their redacted text."""
    schema = F.schema_of_variant("v")
    kind = (
        F.when(F.col("hidden"), "leaf").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise("leaf")
    )
    plain = F.when(schema == "STRING", quoted(X.redact(F.variant_get("v", "$", "string")))).otherwise(F.coalesce(F.to_json("v"), F.lit("null")))
    return nodes.withColumn("kind", kind).withColumn(
        "text", F.when(F.col("hidden"), MARK).when(F.col("kind") == "leaf", plain)
    )


def _children(nodes: DataFrame) -> DataFrame:
    """The values inside objects and arrays, with their place and name."""
    opened = nodes.where("kind <> 'leaf'").select("row_key", F.col("path").alias("parent"), "v", "kind")
    inside = opened.sparkSession.sql(
        "SELECT row_key, parent, kind AS within, pos, key AS name, value AS v FROM {opened}, LATERAL variant_explode(v)", opened=opened
    )
    hidden = (F.col("within") == "object") & F.coalesce(X.is_sensitive_key(F.col("name")), F.lit(False))
    return inside.withColumn("hidden", hidden).withColumn("path", F.concat("parent", F.lit("/"), F.col("pos").cast("string")))


def redact_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key`` and ``redacted``: the JSON text of ``column`` without secrets, keys sorted, no blanks.

    ``key`` names a row; its values differ. A null text, or one that is not JSON, gives null.
    An object that repeats a name, which is not a variant, gives null too.
    """
    start = rows.select(F.col(key).alias("row_key"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    level = cut_lineage(_described(start.withColumn("path", F.lit("")).withColumn("hidden", F.lit(False))))
    levels = [level.select("row_key", "path", "kind", "text")]
    while not level.where("kind <> 'leaf'").isEmpty():  # one round per level of the deepest document
        level = cut_lineage(_described(_children(level)))
        levels.append(level.select("row_key", "path", "parent", "pos", "name", "kind", "text"))
    done = None  # texts of the nodes below
    for nodes in reversed(levels):
        if done is not None:
            entry = F.struct(F.col("name"), F.col("pos"), F.col("text"))
            gathered = done.groupBy("row_key", F.col("parent").alias("path")).agg(F.sort_array(F.collect_list(entry)).alias("items"))
            nodes = nodes.join(gathered, ["row_key", "path"], "left")
            fields = F.transform("items", lambda e: F.concat(quoted(e["name"]), F.lit(":"), e["text"]))
            values = F.transform("items", lambda e: e["text"])
            nodes = nodes.withColumn(
                "text",
                F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce(F.array_join(fields, ","), F.lit("")), F.lit("}")))
                .when(F.col("kind") == "array", F.concat(F.lit("["), F.coalesce(F.array_join(values, ","), F.lit("")), F.lit("]")))
                .otherwise(F.col("text")),
            ).drop("items")
        else:
            empty = F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]")
            nodes = nodes.withColumn("text", F.coalesce("text", empty))
        done = nodes
    return rows.select(F.col(key).alias("row_key")).join(done.select("row_key", "text"), "row_key", "left").select(
        F.col("row_key").alias(key), F.col("text").alias("redacted")
    )
