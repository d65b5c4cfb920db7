"""Detectors on module JSON rows (file, module, functions): one row for each function, then predicates on its calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PERMISSION = ["File.chmod", "File.chown", "File.chgrp"]
NON_ATOMIC = ["File.rename", "File.cp", "File.rm"]
UNBOUNDED = ["File.read", "File.read!", "IO.read", "File.stream!"]


def functions(modules: DataFrame) -> DataFrame:
    fn = modules.select("file", "module", F.explode("functions").alias("f"))
    return fn.select("file", "module", "f.name", "f.line", "f.calls", "f.params")


def _row(df: DataFrame, rule: str, severity: str, line: Column | None = None, subject: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "file", (F.col("line") if line is None else line).alias("line"), (F.col("name") if subject is None else subject).alias("subject"))


def _called(fn: DataFrame, names: list[str], rule: str, severity: str) -> DataFrame:
    c = fn.select("file", "name", F.explode("calls").alias("c")).where(F.col("c.name").isin(*names))
    return _row(c, rule, severity, F.col("c.line"), F.col("c.name"))


def long_functions(fn: DataFrame, calls: int = 30) -> DataFrame:
    return _row(fn.where(F.size("calls") >= calls), "LongFunction", "Medium")


def blanket_rescue(fn: DataFrame) -> DataFrame:
    return _row(fn.where(F.exists("calls", lambda c: (c["name"] == "rescue") & (F.size(c["args"]) == 0))), "BlanketRescue", "Medium")


def unused_exceptions(fn: DataFrame) -> DataFrame:
    """A rescue that names its exception and never uses it."""
    c = fn.select("file", "name", "calls", F.explode("calls").alias("c")).where("c.name = 'rescue' AND size(c.args) > 0")
    unused = ~F.exists("calls", lambda o: (o["name"] != "rescue") & F.array_contains(o["args"], F.col("c.args")[0]))
    return _row(c.where(unused), "UnusedExceptions", "Low", F.col("c.line"))


def unbounded_recursion(fn: DataFrame) -> DataFrame:
    """A function that calls itself in its first call, before anything could stop it."""
    first = F.get(F.sort_array(F.transform("calls", lambda c: F.struct(c["line"].alias("line"), c["name"].alias("name")))), 0)
    return _row(fn.where(F.size("calls") > 0).where(first["name"] == F.col("name")), "UnboundedRecursion", "Medium")


def sanitizer_bypass(fn: DataFrame) -> DataFrame:
    """A parameter that is sanitised and still handed on raw to a later call."""
    c = fn.select("file", "name", "params", F.explode("calls").alias("c"), "calls").where(F.col("c.name").rlike("(?i)sanitize|escape|validate"))
    raw = F.exists("calls", lambda o: (o["line"] > F.col("c.line")) & ~o["name"].rlike("(?i)sanitize|escape|validate") & F.exists(o["args"], lambda a: F.array_contains("params", a) & F.array_contains(F.col("c.args"), a)))
    return _row(c.where(raw), "SanitizerBypass", "High", F.col("c.line"))


def dangerous_whitelist(fn: DataFrame) -> DataFrame:
    """cast / permit of keys that decide rights."""
    c = fn.select("file", "name", F.explode("calls").alias("c")).where(F.substring_index("c.name", ".", -1).isin("cast", "permit")).where(F.exists("c.args", lambda a: a.rlike("(?i)(?:^|[:\"\\[, ])(?:admin|role|is_admin|password_hash|permissions)\\b")))
    return _row(c, "DangerousWhitelistKey", "High", F.col("c.line"))


def all_module_smells(modules: DataFrame) -> DataFrame:
    fn = functions(modules)
    parts = [
        blanket_rescue(fn), long_functions(fn), unused_exceptions(fn), _called(fn, PERMISSION, "IgnoredPermissionOp", "Low"), _called(fn, NON_ATOMIC, "NonAtomicFileOp", "Low"),
        _called(fn, UNBOUNDED, "UnboundedFileRead", "Low"), sanitizer_bypass(fn), unbounded_recursion(fn), dangerous_whitelist(fn),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
