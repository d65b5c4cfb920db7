"""Reports of any size, written by the tasks that hold their lines.

A report is a folder of text files; put one after the other in the order of their names they are the document. Findings are
sorted by range partitions, so no task and not the driver sees them all; the envelope is the first and the last line. What the
driver holds: counts by label, the distinct rules, one number. Findings without rows give the envelope alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .fixpoint import durable
from .reports import COLOURS, LEVELS, finding_object


def _written(lines: DataFrame, path: str, head: str, tail: str, joint: str = "") -> None:
    """``lines(keys..., value)`` in the order of their keys between ``head`` and ``tail``; ``joint`` stands before each but the first."""
    keys = [c for c in lines.columns if c != "value"]
    if joint:
        # repeated lines are told apart by a number, which must not change: the lines are written before one is called first
        lines = durable(lines.withColumn("_id", F.monotonically_increasing_id()))
        keys.append("_id")
        first = lines.agg(F.min_by("_id", F.struct(*keys))).first()[0]
        lines = lines.withColumn("value", F.when(F.col("_id") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(joint), "value")))
    ends = lines.sparkSession.createDataFrame([(0, head), (2, tail)], "_place int, value string")
    order = ["_place", *keys]
    whole = lines.withColumn("_place", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    whole.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def _lines(found: DataFrame, value: Column) -> DataFrame:
    """Findings by severity, file, line and rule, as in the reports for people."""
    return found.select((-P.severity_rank(F.col("severity"))).alias("_rank"), "file", "line", "rule", value.alias("value"))


def write_json(found: DataFrame, files: int, path: str) -> None:
    """The report envelope with a finding a line; fields without a value are left out (K-02, K-06)."""
    counts = {r["label"]: r["n"] for r in found.groupBy(P.severity_label(F.col("severity")).alias("label")).agg(F.count("*").alias("n")).collect()}
    head = json.dumps({"files_scanned": files, "summary": {k: counts.get(k, 0) for k in ("Error", "Warning", "Info")}})
    _written(_lines(found, finding_object(found)), path, head[:-1] + ', "findings": [', "]}", ",")


def _place(file: Column, line: Column) -> Column:
    region = F.struct(F.greatest(F.lit(1), F.coalesce(line, F.lit(1))).alias("startLine"))
    return F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), region.alias("region"))


def _result(found: DataFrame) -> Column:
    """A finding as one SARIF result."""
    level = F.coalesce(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.lower("severity")], F.lit("note"))
    fields = [
        F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(_place(F.col("file"), F.col("line")).alias("physicalLocation"))).alias("locations"),
    ]
    if "flow" in found.columns:
        step = lambda s: F.struct(F.struct(_place(s["file"], s["line"]).alias("physicalLocation"), F.struct(s["message"].alias("text")).alias("message")).alias("location"))
        flows = F.array(F.struct(F.array(F.struct(F.transform("flow", step).alias("locations"))).alias("threadFlows")))
        fields.append(F.when(F.size("flow") > 0, flows).alias("codeFlows"))
    if "reachability" in found.columns:
        r = F.col("reachability")
        way = F.transform(F.coalesce(r["path"], F.array().cast("array<struct<file:string,line:int>>")), lambda p: F.concat(p["file"], F.lit(":"), p["line"]))
        entered = r["entry_function"].isNotNull() & (r["entry_function"] != "")
        known = [F.when(entered, x).alias(name) for name, x in (("entryPoint", r["entry_point"]), ("entryFunction", r["entry_function"]), ("pathLength", r["path_length"]), ("path", way))]
        fields.append(F.when(r.isNotNull(), F.struct(F.struct(r["status"].alias("status"), *known).alias("reachability"))).alias("properties"))
    return F.to_json(F.struct(*fields))


def write_sarif(found: DataFrame, path: str, tool: str = "sparkhound", version: str = "1.0") -> None:
    """SARIF 2.1.0 with a result a line; rules in the order of their names (K-03)."""
    rules = [{"id": r[0]} for r in found.select("rule").distinct().orderBy("rule").collect()]
    run = json.dumps({"tool": {"driver": {"name": tool, "version": version, "rules": rules}}}, ensure_ascii=False)
    head = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [' + run[:-1] + ', "results": ['
    _written(_lines(found, _result(found)), path, head, "]}]}", ",")


def write_markdown(found: DataFrame, path: str) -> None:
    """One section a finding (K-04)."""
    text = F.concat(
        F.lit("## "), "rule", F.lit(" ("), "severity", F.lit(")\n\n`"), "file", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("None")), F.lit("`\n\n"), "message", F.lit("\n")
    )
    if "flow" in found.columns:
        steps = F.transform("flow", lambda s, k: F.concat((k + 1).cast("string"), F.lit(". `"), s["file"], F.lit(":"), s["line"].cast("string"), F.lit("` "), s["message"]))
        text = F.concat(text, F.when(F.size("flow") > 0, F.concat(F.lit("\n"), F.array_join(steps, "\n"))).otherwise(F.lit("")))
    if "suggestion" in found.columns:
        text = F.concat(text, F.when(F.col("suggestion") != "", F.concat(F.lit("\nFix: `"), "suggestion", F.lit("`\n"))).otherwise(F.lit("")))
    _written(_lines(found, text), path, "# Findings\n", "")


def write_dot(edges: DataFrame, classes: DataFrame, path: str) -> None:
    """The call graph, nodes before links; colours by class (K-05)."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])[F.col("class")]
    nodes = classes.select(F.lit(0).alias("part"), F.col("name").alias("a"), F.lit("").alias("b"), F.concat(F.lit("  "), quote(F.col("name")), F.lit(" [color="), colour, F.lit("];")).alias("value"))
    link = F.concat(F.lit("  "), quote(F.col("caller")), F.lit(" -> "), quote(F.col("callee")), F.lit(";"))
    links = edges.select("caller", "callee").distinct().select(F.lit(1).alias("part"), F.col("caller").alias("a"), F.col("callee").alias("b"), link.alias("value"))
    _written(nodes.unionByName(links), path, "digraph calls {", "}")
