"""Ancestors in trees numbered in pre-order, as windows: no join, no loop, no row-by-row walk.

A subtree is the interval from a row's pre-order number to that of its last descendant, so intervals nest or are apart. Counting
starts and ends gives how many rows of a kind are open around each row; of these the nearest is the last one before it
that is open at the same level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_level(rows: DataFrame, keys: list[str], which: Column, prefix: str) -> DataFrame:
    """Adds ``{prefix}_level``: how many rows that meet ``which`` are open around a row, itself aside.

    ``rows`` has pre_order and subtree_end, numbered within ``keys``. One sort by them, no shuffle where rows are dealt by keys.
    """
    marked = rows.withColumn("_on", F.coalesce(which, F.lit(False)))
    start, end = F.struct((F.col("pre_order") * 2).alias("at"), F.col("_on").cast("int").alias("step")), F.struct((F.col("subtree_end") * 2 + 1).alias("at"), F.lit(-1).alias("step"))
    events = marked.withColumn("_e", F.explode(F.when(F.col("_on"), F.array(start, end)).otherwise(F.array(start))))
    before = Window.partitionBy(*keys).orderBy("_e.at").rowsBetween(Window.unboundedPreceding, -1)
    counted = events.withColumn(f"{prefix}_level", F.coalesce(F.sum("_e.step").over(before), F.lit(0)).cast("int"))
    return counted.where("_e.step >= 0").drop("_on", "_e")


def with_nearest(rows: DataFrame, keys: list[str], which: Column, prefix: str, take: list[Column]) -> DataFrame:
    """Adds ``{prefix}_level`` and, as the struct ``{prefix}``, columns of the nearest open row that meets ``which`` (null: there is none)."""
    level = f"{prefix}_level"
    leveled = with_level(rows.withColumn("_mark", F.coalesce(which, F.lit(False))), keys, F.col("_mark"), prefix)
    asked, given = F.struct(F.col(level).alias("b"), F.lit(True).alias("asks")), F.struct((F.col(level) + 1).alias("b"), F.lit(False).alias("asks"))
    both = leveled.withColumn("_q", F.explode(F.when(F.col("_mark"), F.array(asked, given)).otherwise(F.array(asked))))
    before = Window.partitionBy(*keys, "_q.b").orderBy("pre_order").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn(prefix, F.last(F.when(~F.col("_q.asks"), F.struct(*take)), ignorenulls=True).over(before)).where("_q.asks")
    return found.withColumn(prefix, F.when(F.col(level) > 0, F.col(prefix))).drop("_mark", "_q")


def within(rows: DataFrame, keys: list[str], outer: Column, inner: Column, take: list[Column], nearest: int | None = None) -> DataFrame:
    """One row for each row that meets ``inner`` and each row that meets ``outer`` around it, with the latter's columns as the struct ``outer``.

    ``nearest``: only so many of them, from the inside.
    """
    leveled = with_level(rows.withColumn("_mark", F.coalesce(outer, F.lit(False))), keys, F.col("_mark"), "_o")
    first = F.lit(1) if nearest is None else F.greatest(F.lit(1), F.col("_o_level") - (nearest - 1))
    ask = F.when(F.coalesce(inner, F.lit(False)) & (F.col("_o_level") > 0), F.transform(F.sequence(first, F.col("_o_level")), lambda b: F.struct(b.alias("b"), F.lit(True).alias("asks"))))
    give = F.when(F.col("_mark"), F.array(F.struct((F.col("_o_level") + 1).alias("b"), F.lit(False).alias("asks"))))
    none = F.array().cast("array<struct<b:int,asks:boolean>>")
    both = leveled.withColumn("_q", F.explode(F.concat(F.coalesce(ask, none), F.coalesce(give, none))))
    before = Window.partitionBy(*keys, "_q.b").orderBy("pre_order").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("outer", F.last(F.when(~F.col("_q.asks"), F.struct(*take)), ignorenulls=True).over(before)).where("_q.asks").drop("_mark", "_q", "_o_level")
