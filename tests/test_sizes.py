"""Steps whose sides grow with the input do not send them whole through the driver, and do not shuffle what is whole in a task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_syntax_trees import GLEAM, JS

from sparkhound import tree_queries
from sparkhound.operators import imports, statics, taint, trees
from sparkhound.plans.fixpoint import durable
from sparkhound.schema import EXPRS
from sparkhound.sources.tree_rules import tree_rules
from sparkhound.sources.xml_trees import xml_trees

SF = "/root/testdata/sf0.001"
ARGS = "array<struct<arg_type:string,value:string,field:string>>"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_taint_and_imports_are_merged_not_broadcast(spark):
    row = ("a", 1, 1, "assign", "x", [("call", "f", "")], False, "crystal", {})
    n = durable(spark.createDataFrame([row], f"file string, ord long, line int, node_type string, name string, args {ARGS}, taint boolean, language string, metadata map<string,string>"))
    known = durable(spark.createDataFrame([("a", "x", "", "s")], "file string, var string, field string, source string"))
    seen = durable(spark.createDataFrame([("a", "b")], "file string, imported_file string"))
    for df in (taint.flows(n), taint.tainted_returns(n, known), taint.from_returns(n, taint.tainted_returns(n, known), seen), imports.resolved_imports(n, n)):
        assert "Broadcast" not in _plan(df)


def test_static_variables_are_merged_not_broadcast(spark):
    rows = [("a", k, k, "assign", v, [(t, x, "")], False, "crystal", {}) for k, (v, t, x) in enumerate([("x", "literal", "1"), ("y", "var", "x"), ("z", "call", "f"), ("w", "var", "z"), ("r", "var", "s"), ("s", "var", "r")])]
    n = durable(spark.createDataFrame(rows, f"file string, ord long, line int, node_type string, name string, args {ARGS}, taint boolean, language string, metadata map<string,string>"))
    found = statics.static_variables(n)
    assert "Broadcast" not in _plan(found)
    assert {r["var"] for r in found.collect()} == {"x", "y", "r", "s"}


def test_trees_are_contracted_where_they_are_parsed(spark):
    docs = durable(spark.createDataFrame([("f", GLEAM, "gleam")], "file string, content string, language string"))
    plan = _plan(trees.document_expressions(docs, tree_rules(spark)))
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan


def test_facts_of_many_files_are_sent_on_together():
    rows = [(f"f{k:04}", "a", None, "b", None, False) for k in range(3000)]
    rows = sorted(rows + [(f"f{k:04}", "a", "", "s", None, True) for k in range(0, 3000, 2)], key=lambda r: (r[0], r[5]))
    kinds = [pa.string()] * 5 + [pa.bool_()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 700], strict=True), kinds, strict=True)], list("fabcds")) for at in range(0, len(rows), 700)]
    got = list(taint._closures(batches))
    assert len(got) == 1
    assert sorted(zip(*(c.to_pylist() for c in got[0].columns), strict=True)) == [(f"f{k:04}", v, "", "s") for k in range(0, 3000, 2) for v in "ab"]
    assert not list(taint._closures(batches[:0]))


@pytest.mark.parametrize("few", [0, 100_000])
def test_rounds_go_through_files_that_learn_something(spark, monkeypatch, few):
    """Taint goes from file to file, m0 to m2; each round reads the edges of one."""
    rows = [("m0", 1, 1, "def", "f0", [], False, "crystal", {}), ("m0", 2, 2, "assign", "v", [("call", "params.get", "")], False, "crystal", {})]
    for k in range(1, 3):
        rows += [(f"m{k}", 1, 1, "def", f"f{k}", [], False, "crystal", {}), (f"m{k}", 2, 2, "assign", "u", [("call", f"f{k - 1}", "")], False, "crystal", {}), (f"m{k}", 3, 3, "assign", "v", [("var", "u", "")], False, "crystal", {})]
    n = durable(spark.createDataFrame(rows, f"file string, ord long, line int, node_type string, name string, args {ARGS}, taint boolean, language string, metadata map<string,string>"))
    seen = durable(spark.createDataFrame([(f"m{k}", f"m{k - 1}") for k in range(1, 3)], "file string, imported_file string"))
    read, propagate = [], taint.propagate
    monkeypatch.setattr(taint, "FEW", few)
    monkeypatch.setattr(taint, "propagate", lambda seed, edges, *a: (read.append({r["file"] for r in edges.collect()}), propagate(seed, edges, *a))[1])
    assert {(r["file"], r["var"]) for r in taint.analyse(n, seen).collect()} == {("m0", "v")} | {(f"m{k}", v) for k in range(1, 3) for v in "uv"}
    assert read[1:] == [{f"m{k}"} for k in range(1, 3)]


ODD = [
    ("empty", ""), ("null", None), ("broken", "<function><identifier field='name'>f</identifier><block><identifier>x"), ("text", "no xml"), ("deep", "<block>" * 300 + "<identifier>z</identifier>" + "</block>" * 300),
    ("outside", "<source_file><let><identifier field='pattern'>a</identifier><integer>1</integer></let><function><identifier field='name'>g</identifier><function><identifier field='name'>h</identifier><identifier>q</identifier></function></function><let><identifier field='pattern'>b</identifier><identifier>a</identifier></let></source_file>"),
    ("dropped", "<block><comment><identifier>x</identifier></comment><string>'</string><string>\"\"</string></block>"), ("gleam", GLEAM), ("js", JS),
]


@pytest.mark.parametrize("language", ["gleam", "javascript", "unknown"])
def test_contraction_in_a_task_equals_the_windows(spark, language):
    docs = spark.createDataFrame(ODD, "file string, content string").withColumn("language", F.lit(language))
    _equal(spark, docs)


def test_contraction_of_the_fixture_equals_the_windows(spark):
    _equal(spark, tree_queries.documents(spark, SF).where("pmod(xxhash64(file), 10) = 0"))


def _equal(spark, docs):
    columns = [c.split()[0] for c in EXPRS.split(", ")]
    nodes = xml_trees(docs).join(docs.select("file", "language"), "file")
    want = trees.expressions(nodes, tree_rules(spark)).select(columns)
    got = trees.document_expressions(docs, tree_rules(spark)).select(columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
