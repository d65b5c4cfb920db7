import json

from pyspark.sql import functions as F

from sparkhound.operators import modules
from sparkhound.sources import external, project


def body(spark, x):
    return spark.createDataFrame([(json.dumps(x),)], "body string")


def test_tool_reports(spark):
    a = external.ameba(body(spark, {"sources": [{"path": "a.cr", "issues": [{"rule_name": "Lint/X", "severity": "Error", "message": "m", "location": {"line": 3}}]}]}))
    c = external.credo(body(spark, {"issues": [{"check": "Y", "category": "design", "filename": "b.ex", "line_no": 4, "message": "m"}]}))
    s = external.sobelow(body(spark, {"findings": {"high_confidence": [{"type": "Z", "file": "c.ex", "line": 5}], "medium_confidence": []}}))
    t = external.text_lines(spark.createDataFrame([("d.nim(6, 1) Warning: odd [W1]",), ("e.nim:7: [R] text",), ("noise",)], "value string"), "Nim")
    got = {(r["rule"], r["severity"], r["file"], r["line"]) for r in a.unionByName(c).unionByName(s).unionByName(t).collect()}
    assert got == {("Ameba:Lint/X", "High", "a.cr", 3), ("Credo:Y", "Medium", "b.ex", 4), ("Sobelow:Z", "High", "c.ex", 5), ("Nim:W1", "Low", "d.nim", 6), ("Nim:R", "Low", "e.nim", 7)}


def test_cache(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    cache = spark.createDataFrame([("a", "1", "old"), ("b", "1", "stale"), ("gone", "1", "x")], "path string, hash string, nodes_json string")
    got = external.refreshed(files, cache, lambda f: f.withColumn("nodes_json", F.lit("new")))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "1", "old"), ("b", "2", "new")]
    rows = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("y", "2024-01-02 12:00:00")], "name string, t string").select("name", F.to_timestamp("t").alias("fetched_at"))
    assert [r["name"] for r in external.fresh(rows, F.to_timestamp(F.lit("2024-01-03 00:00:00"))).collect()] == ["y"]
    assert [tuple(r) for r in external.feedback_counts(spark.createDataFrame([("a",), ("b",), ("b",)], "type string")).collect()] == [("b", 2), ("a", 1)]


def test_modules(spark, tmp_path):
    def call(name, line, *args):
        return {"name": name, "line": line, "args": list(args)}

    fns = [
        {"name": "loop", "arity": 0, "line": 1, "params": [], "calls": [call("loop", 2)]},
        {"name": "save", "arity": 1, "line": 5, "params": ["p"], "calls": [call("sanitize", 6, "p"), call("Repo.query", 7, "p"), call("File.read", 8, "x"), call("cast", 9, "user", ":role, :name"), call("rescue", 10), call("rescue", 11, "e")]},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"file": "a.ex", "module": "A", "functions": fns}))
    m = spark.read.schema(project.MODULE).json(str(tmp_path / "m.json"))
    got = {(r["rule"], r["line"]) for r in modules.all_module_smells(m).collect()}
    assert got == {("UnboundedRecursion", 1), ("SanitizerBypass", 6), ("UnboundedFileRead", 8), ("DangerousWhitelistKey", 9), ("BlanketRescue", 5), ("UnusedExceptions", 11)}
    nodes = project.elixir_nodes(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [(r["node_type"], r["name"]) for r in nodes][:3] == [("def", "loop"), ("call", "loop"), ("def", "save")]
