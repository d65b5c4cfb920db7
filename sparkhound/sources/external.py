"""Results of other tools, extraction cache and feedback, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FINDINGS

_NAMES = ["rule", "severity", "file", "line", "message"]


def as_findings(df: DataFrame, tool: str) -> DataFrame:
    """Rows (rule, severity, file, line, message) in the shape of schema.FINDINGS; the tool's name leads the rule."""
    empty = df.sparkSession.createDataFrame([], FINDINGS)
    named = df.select(F.concat(F.lit(f"{tool}:"), "rule").alias("rule"), *_NAMES[1:])
    return empty.unionByName(named, allowMissingColumns=True)


def _level(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.isin("error", "fatal", "high"), "High").when(k.isin("warning", "medium", "design", "readability"), "Medium").otherwise("Low")


def ameba(reports: DataFrame) -> DataFrame:
    """From (body): {"sources": [{"path", "issues": [{"rule_name", "severity", "message", "location": {"line"}}]}]}."""
    shape = "sources array<struct<path:string,issues:array<struct<rule_name:string,severity:string,message:string,location:struct<line:int>>>>>"
    rows = reports.select(F.explode(F.from_json("body", shape)["sources"]).alias("s")).select("s.path", F.explode("s.issues").alias("i"))
    return as_findings(rows.select(F.col("i.rule_name").alias("rule"), _level(F.col("i.severity")).alias("severity"), F.col("path").alias("file"), F.col("i.location.line").alias("line"), F.col("i.message")), "Ameba")


def credo(reports: DataFrame) -> DataFrame:
    """From (body): {"issues": [{"check", "category", "filename", "line_no", "message"}]}."""
    shape = "issues array<struct<check:string,category:string,filename:string,line_no:int,message:string>>"
    rows = reports.select(F.explode(F.from_json("body", shape)["issues"]).alias("i"))
    return as_findings(rows.select(F.col("i.check").alias("rule"), _level(F.col("i.category")).alias("severity"), F.col("i.filename").alias("file"), F.col("i.line_no").alias("line"), F.col("i.message")), "Credo")


def sobelow(reports: DataFrame) -> DataFrame:
    """From (body): {"findings": {"high_confidence": [{"type", "file", "line"}], "medium_confidence": [], "low_confidence": []}}."""
    item = "array<struct<type:string,file:string,line:int>>"
    found = F.from_json("body", f"findings struct<high_confidence:{item},medium_confidence:{item},low_confidence:{item}>")["findings"]
    out = None
    for key, severity in (("high_confidence", "High"), ("medium_confidence", "Medium"), ("low_confidence", "Low")):
        rows = reports.select(F.explode(found[key]).alias("i")).select(F.col("i.type").alias("rule"), F.lit(severity).alias("severity"), "i.file", "i.line", F.col("i.type").alias("message"))
        out = rows if out is None else out.unionByName(rows)
    return as_findings(out, "Sobelow")


def text_lines(lines: DataFrame, tool: str) -> DataFrame:
    """From (value): lines like ``path:line: [Rule] message`` or ``path(line, col) Warning: message [Rule]``."""
    a = r"^([^\s:(]+):(\d+)(?::\d+)?:?\s+\[?([A-Za-z][\w-]*)\]?:?\s+(.*)$"
    b = r"^([^\s:(]+)\((\d+), ?\d+\)\s+(?:Warning|Error|Hint):\s+(.*?)\s*\[([\w-]+)\]$"
    pick = lambda p, n: F.regexp_extract("value", p, n)
    first = lines.where(F.col("value").rlike(a)).select(pick(a, 3).alias("rule"), F.lit("Low").alias("severity"), pick(a, 1).alias("file"), pick(a, 2).cast("int").alias("line"), pick(a, 4).alias("message"))
    second = lines.where(~F.col("value").rlike(a) & F.col("value").rlike(b)).select(pick(b, 4).alias("rule"), F.lit("Low").alias("severity"), pick(b, 1).alias("file"), pick(b, 2).cast("int").alias("line"), pick(b, 3).alias("message"))
    return as_findings(first.unionByName(second), tool)


def refreshed(files: DataFrame, cache: DataFrame, extract) -> DataFrame:
    """(path, hash, nodes_json): cached rows where path and hash agree, ``extract`` of the other files, nothing of vanished ones (S-20)."""
    hits = files.select("path", "hash").join(cache, ["path", "hash"])
    return hits.unionByName(extract(files.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")))


def fresh(snapshot: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Rows of a fetched table that are not older than their time to live (S-21); whole responses are kept, not their status."""
    return snapshot.where((F.unix_timestamp(now) - F.unix_timestamp("fetched_at")) <= hours * 3600)


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """(type, n), most frequent first (A-15)."""
    return feedback.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")
