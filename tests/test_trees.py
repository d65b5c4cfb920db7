"""Expression trees: numbering, projection to nodes, smells and lint templates."""

import json

import pytest
from pyspark.sql import functions as F

from sparkhound.operators import exprs, smells


def t(kind, name="", children=(), line=1, **more):
    return {"kind": kind, "name": name, "line": line, "children": list(children), **more}


def lit(value, kind="str", line=1):
    return t("literal", literal=value, literal_kind=kind, line=line)


def v(name):
    return t("var", name)


TREES = {
    "f": t("function", "f", [
        t("param", "a"), t("param", "unused"),
        t("let", "x", [t("binary", op="+", children=[lit("7", "int"), v("a")])], line=2),
        t("app", "system", [t("binary", op="&", children=[lit("rm "), v("x")])], line=3),
        t("if", children=[t("binary", op="==", children=[v("x"), lit("1.5", "float")]), t("return", line=4), t("app", "puts", line=5)], line=4),
        t("case", children=[v("a"), t("case", children=[v("a"), lit("1", "int")], line=6)], line=6),
        t("try", children=[t("rescue", line=7), t("ensure", children=[t("return", line=8)], line=8)], line=7),
        t("app", "File.exists?", [v("x")], line=9), t("app", "File.read", [v("x")], line=10),
        t("app", "go", [lit("ghp_0123456789abcdefghij", line=11), lit("https://host.example/x", line=11), lit("TODO later", line=11)], line=11),
    ]),
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("trees") / "t.json"
    path.write_text("\n".join([json.dumps({"file": "a", "fn": k, "tree": x}) for k, x in TREES.items()] + ["broken", "{}"]))
    return exprs.read_trees(spark, str(path)).cache()


def test_numbering(rows):
    got = rows.orderBy("pre_order").collect()
    assert got[0]["subtree_end"] == len(got) - 1 and got[0]["parent_id"] is None
    by = {r["expr_id"]: r for r in got}
    assert all(by[r["parent_id"]]["pre_order"] < r["pre_order"] <= by[r["parent_id"]]["subtree_end"] and by[r["parent_id"]]["depth"] + 1 == r["depth"] for r in got[1:])
    deep = x = t("a")
    for _ in range(5000):
        y = t("a")
        x["children"], x = [y], y
    assert exprs.flatten("f", "g", deep)[0][13] == 5000


def test_to_nodes(rows):
    got = {(r["line"], r["node_type"], r["name"]): [(a["arg_type"], a["value"]) for a in r["args"]] for r in exprs.to_nodes(rows).collect()}
    assert got[1, "def", "f"] == [("var", "a"), ("var", "unused")]
    assert got[3, "call", "system"] == [("unknown", "<expr:x>"), ("var", "x")]
    assert got[2, "assign", "x"] == [("unknown", "<expr:a>"), ("var", "a")]
    assert (4, "control", "if_else") in got and (4, "terminator", "") in got and (7, "call", "try") in got
    assert got[6, "control", "case"] == [("literal", "2")]


def test_lint(rows, spark):
    names = spark.createDataFrame([("hallucinated-method", "Error", "go", "no such")], "rule string, severity string, name string, hint string")
    got = {(r["rule"], r["line"]) for r in exprs.lint(rows, names).collect()}
    want = {
        ("hallucinated-method", 11), ("unused-binding", 1), ("MagicNumber", 1), ("EmptyCatch", 7), ("ReturnFromFinally", 8), ("FloatEquality", 1), ("hardcoded-secrets", 11),
        ("hardcoded-urls", 11), ("todo-in-code", 11), ("nested-case", 6), ("toctou-pattern", 10), ("unreachable-code", 5),
    }
    assert want <= got, want - got
    assert not any(rule in ("HighComplexity", "shadow-variable", "nested-ternary") for rule, _ in got)


def test_complexity_leaves_conditions_out(spark):
    cond = t("binary", op="&&", children=[v("a"), v("b")])
    body = [t("if", children=[cond, t("app", "x"), t("app", "y")]) for _ in range(5)]
    df = spark.createDataFrame(exprs.flatten("a", "f", t("function", "f", body)), exprs.EXPRS)
    assert [(r["severity"], r["subject"]) for r in exprs.complexity(df).collect()] == [("Medium", "11")]


def test_duplicate_trees(spark):
    def make(name):
        return t("function", "", [t("let", name, [t("app", "compute_something", [v(name), lit("10"), lit("a longer literal")])])])

    four = [r for k in range(4) for r in exprs.flatten(f"file{k}", "f", make(f"v{k}"))]
    got = exprs.duplicate_trees(spark.createDataFrame(four, exprs.EXPRS)).collect()
    assert got and all(r["n"] == 4 and r["files"] == 4 for r in got)
    assert exprs.duplicate_trees(spark.createDataFrame(four[: len(four) * 3 // 4], exprs.EXPRS)).count() == 0


def test_intimacy_and_smells_over_derived_nodes(spark, rows):
    tree = t("function", "f", [t("field", f"other.x{k}") for k in range(4)])
    df = spark.createDataFrame(exprs.flatten("a", "f", tree), exprs.EXPRS)
    assert [r["subject"] for r in exprs.intimacy(df).collect()] == ["other"]
    assert smells.long_method(exprs.to_nodes(rows)).count() == 0
    assert exprs.literal_match(rows, F.col("literal") == "7", "r", "s").count() == 1
