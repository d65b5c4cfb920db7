"""Which function or class a row belongs to, as windows instead of range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAR = 2147483647


def function_scopes(nodes: DataFrame, kinds: tuple[str, ...] = ("def",)) -> DataFrame:
    """(file, func_name, start_line, end_line): a definition owns the lines up to the next one (W-01)."""
    w = Window.partitionBy("file").orderBy("line", "name")
    return nodes.where(F.col("node_type").isin(*kinds)).select(
        "file", F.col("name").alias("func_name"), F.col("line").alias("start_line"), F.coalesce(F.lead("line").over(w) - 1, F.lit(FAR)).cast("int").alias("end_line")
    )


#: Scopes that scoped() works out once, by prefix.
KINDS = {"scope": ("def",), "type": ("class", "module", "enum"), "class": ("class",)}


def scoped(nodes: DataFrame) -> DataFrame:
    """``nodes`` with all scopes of KINDS from one shuffle by file; with_scope() takes them from there."""
    for prefix, kinds in KINDS.items():
        nodes = with_scope(nodes, kinds, prefix=prefix)
    return nodes


def with_scope(nodes: DataFrame, kinds: tuple[str, ...] = ("def",), strict: bool = False, prefix: str = "scope") -> DataFrame:
    """Adds ``{prefix}_name`` and ``{prefix}_line`` of the latest definition at or before a row (J-03, J-05).

    ``strict``: before the row only, so that a definition belongs to the previous one (J-04). One shuffle by file.
    """
    if not strict and KINDS.get(prefix) == tuple(kinds) and f"{prefix}_line" in nodes.columns:
        return nodes
    here = F.col("node_type").isin(*kinds)
    w = Window.partitionBy("file").orderBy("line", "ord").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    last = F.last(F.when(here, F.struct("name", "line")), ignorenulls=True).over(w)
    if strict:  # definitions on the row's own line do not count
        last = F.last(F.when(here, F.struct("name", "line")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rangeBetween(Window.unboundedPreceding, -1))
    return nodes.withColumn("_scope", last).withColumns({f"{prefix}_name": F.col("_scope.name"), f"{prefix}_line": F.col("_scope.line")}).drop("_scope")


def body_sizes(nodes: DataFrame) -> DataFrame:
    """(file, func_name, start_line, n_nodes): rows a function owns, its definition aside (A-02)."""
    inside = with_scope(nodes).where("scope_line is not null")
    return inside.groupBy("file", F.col("scope_name").alias("func_name"), F.col("scope_line").alias("start_line")).agg(F.sum((F.col("node_type") != "def").cast("bigint")).alias("n_nodes"))


def last_call_on_line(nodes: DataFrame) -> DataFrame:
    """One call for each (file, line): the last in input order (J-01)."""
    return nodes.where("node_type = 'call'").groupBy("file", "line").agg(F.max_by(F.struct("name", "args"), "ord").alias("call"))
