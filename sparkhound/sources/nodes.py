"""Node tables: from JSON lines, and from the events fixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ARG, NODE_TYPES

#: What the JSON may hold; values of metadata may be strings, booleans or numbers.
_RAW = f"node_type string, type string, name string, args array<{ARG}>, line int, taint boolean, file string, language string, metadata map<string,string>"


def normalised_kind(kind: Column) -> Column:
    """Unknown or missing kinds are calls."""
    return F.when(kind.isin(*NODE_TYPES), kind).otherwise("call")


def read_json_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes from JSON lines. Rows without file, name or line are dropped; order inside a file is that of its lines."""
    raw = spark.read.schema(_RAW).json(path).where("file is not null and name is not null and line is not null")
    kind = normalised_kind(F.coalesce("node_type", "type", F.lit("call")))
    args = F.transform(F.coalesce("args", F.array().cast(f"array<{ARG}>")), lambda a: F.struct(F.coalesce(a["arg_type"], F.lit("unknown")).alias("arg_type"), a["value"].alias("value"), F.coalesce(a["field"], F.lit("")).alias("field")))
    return raw.select(
        "file", F.monotonically_increasing_id().alias("ord"), "line", kind.alias("node_type"), "name", args.alias("args"), F.coalesce("taint", F.lit(False)).alias("taint"),
        F.coalesce("language", F.lit("")).alias("language"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def event_nodes(events: DataFrame) -> DataFrame:
    """The events fixture as program facts: a user's events are a file, its sign-ups start functions."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = events.select(F.col("user_id").cast("string").alias("file"), "event_id", "ts", "event_type", k.alias("k"), "user_id")
    w = Window.partitionBy("file").orderBy("ts", "event_id")
    line = F.row_number().over(w)
    var = lambda c: F.concat(F.lit("v"), (c % 40).cast("string"))
    kind = F.when(F.col("event_type") == "signup", "def").when(F.col("event_type") == "click", "assign").when(F.col("event_type") == "error", "control").otherwise("call")
    name = F.when(F.col("event_type") == "click", var(F.col("k"))).when(F.col("event_type") == "error", F.lit("if")).otherwise(F.concat(F.lit("fn"), (F.col("k") % 25).cast("string")))
    arg = F.struct(F.lit("var").alias("arg_type"), var(F.lag("k", 1, 0).over(w)).alias("value"), F.lit("").alias("field"))
    return base.select(
        "file", line.cast("bigint").alias("ord"), line.cast("int").alias("line"), kind.alias("node_type"), name.alias("name"), F.array(arg).alias("args"),
        ((F.col("event_type") == "click") & (F.col("k") % 20 == 0)).alias("taint"), F.lit("sample").alias("language"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
