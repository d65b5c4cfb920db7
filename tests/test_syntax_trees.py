"""Syntax trees to expressions and statements, and windows over nested intervals, against recursive counterparts."""

import random

import pytest
from pyspark.sql import functions as F

from sparkhound.operators import cfg, exprs, intervals, lowering, trees
from sparkhound.schema import EXPRS
from sparkhound.sources.tree_rules import tree_rules
from sparkhound.sources.xml_trees import xml_trees

CHOOSES, TAKES = ("if", "ternary", "while", "case"), ("app", "binary", "unary", "let", "assign", "return", "raise", "field", "tuple", "list", "record", "error")


def _expr(spark, docs, language="gleam"):
    rows = xml_trees(spark.createDataFrame(docs, "file string, content string")).withColumn("language", F.lit(language))
    return trees.expressions(rows, tree_rules(spark))


def _seen(df):
    return [tuple(r) for r in df.orderBy("file", "fn_id", "expr_id").select("fn_id", "parent_id", "child_ix", "kind", "name", "literal", "op", "subtree_end").collect()]


GLEAM = (
    '<source_file><comment>x</comment><import srow="0"><module>a/b</module></import><function srow="2"><identifier field="name">go</identifier><function_parameter><identifier field="name">p</identifier></function_parameter>'
    '<block field="body"><let><tuple field="pattern"><identifier>a</identifier><identifier>b</identifier></tuple><function_call field="value"><field_access field="function"><identifier field="record">m</identifier><label field="field">f</label></field_access>'
    '<arguments field="arguments"><argument><type>Int</type><identifier>p</identifier></argument></arguments></function_call></let><string><quoted_content>q</quoted_content></string></block></function></source_file>'
)


def test_contraction_of_one_language(spark):
    assert _seen(_expr(spark, [("f", GLEAM)])) == [
        ("", None, 0, "import", "a/b", None, None, 0),
        ("go@4", None, 0, "function", "go", None, None, 6), ("go@4", 0, 0, "param", "p", None, None, 1), ("go@4", 0, 1, "block", "", None, None, 6), ("go@4", 2, 0, "let", "_", None, None, 5),
        ("go@4", 3, 0, "app", "m.f", None, None, 5), ("go@4", 4, 0, "var", "p", None, None, 5), ("go@4", 2, 1, "literal", "", "q", None, 6),
    ]


JS = (
    '<program><class_declaration><identifier field="name">C</identifier><class_body><method_definition><property_identifier field="name">run</property_identifier><formal_parameters><identifier>x</identifier></formal_parameters>'
    '<statement_block><expression_statement><call_expression><member_expression field="function"><call_expression field="object"><identifier field="function">g</identifier><arguments><identifier>x</identifier></arguments></call_expression>'
    '<property_identifier field="property">send</property_identifier></member_expression><arguments><template_string>a<template_substitution><identifier>x</identifier></template_substitution></template_string></arguments></call_expression></expression_statement>'
    "<return_statement><number>1.5</number></return_statement></statement_block></method_definition></class_body></class_declaration></program>"
)


def test_contraction_of_another_language(spark):
    assert _seen(_expr(spark, [("f", JS)], "javascript")) == [
        ("", None, 0, "class", "C", None, None, 0),
        ("run@4", None, 0, "function", "run", None, None, 9), ("run@4", 0, 0, "param", "x", None, None, 1), ("run@4", 0, 1, "block", "", None, None, 9), ("run@4", 2, 0, "app", "send", None, None, 7),
        ("run@4", 3, -1, "app", "g", None, None, 5), ("run@4", 4, 0, "var", "x", None, None, 5), ("run@4", 3, 0, "binary", "", None, "interpolation", 7), ("run@4", 6, 0, "var", "x", None, None, 7),
        ("run@4", 2, 1, "return", "", None, None, 9), ("run@4", 8, 0, "literal", "", "1.5", None, 9),
    ]


def test_trees_feed_nodes_and_lint(spark):
    e = _expr(spark, [("f", JS)], "javascript")
    nodes = {(r["node_type"], r["name"]): [(a["arg_type"], a["value"]) for a in r["args"]] for r in exprs.to_nodes(e, "javascript").collect()}
    assert nodes["def", "run"] == [("var", "x")] and nodes["call", "send"] == [("unknown", "<expr:x>"), ("var", "x")] and nodes["call", "g"] == [("var", "x")]  # the receiver is no argument
    assert {r["rule"] for r in exprs.lint(e).collect()} == {"MagicNumber"}


def test_awkward_documents(spark):
    docs = [("empty", ""), ("null", None), ("broken", "<function><identifier field='name'>f</identifier><block><identifier>x"), ("text", "no xml"), ("deep", "<block>" * 300 + "<identifier>z</identifier>" + "</block>" * 300), ("dropped", "<comment><identifier>x</identifier></comment>")]
    e = _expr(spark, docs).cache()
    assert {r["file"]: r["n"] for r in e.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"broken": 3, "deep": 301}
    assert e.where("file = 'deep' AND kind = 'var'").first()["depth"] == 300
    assert lowering.lower(e).count() == 0


# -- statements


def _tree(r, depth=0):
    kind = r.choice(["var", "literal", "field", "app", "app", "binary", "let", "assign", "if", "case", "block", "return", "lambda", "ternary", "try", "list", "while"] if depth < 4 else ["var", "literal"])
    kids = lambda a, b: [_tree(r, depth + 1) for _ in range(r.randint(a, b))]
    t = {"kind": kind, "line": r.randint(1, 9), "name": "", "children": []}
    if kind == "var":
        t["name"] = r.choice("abc")
    elif kind == "literal":
        t["literal"] = r.choice("12")
    elif kind == "field":
        t |= {"name": r.choice(["a.b", "b.c"]), "children": kids(0, 1)}
    elif kind == "app":
        t |= {"name": r.choice(["f", "g.h"]), "children": kids(0, 3)}
    elif kind == "binary":
        t |= {"op": "+", "children": kids(2, 2)}
    elif kind in ("let", "assign"):
        t |= {"name": r.choice(["a", "b", "_"]), "children": kids(1, 1)}
    elif kind in ("if", "ternary"):
        t["children"] = kids(2, 3)
    elif kind == "while":
        t["children"] = kids(2, 2)
    elif kind in ("case", "block", "list", "try"):
        t["children"] = kids(1 if kind == "case" else 0, 4)
    elif kind == "return":
        t["children"] = kids(0, 1)
    elif kind == "lambda":
        t["children"] = [{"kind": "param", "name": r.choice("ab"), "line": 1}, *kids(1, 2)]
    return t


def _lowered(tree, fn):
    """(fn, kind, lhs, callee, args, line) by recursion."""
    out, count = [], [0]

    def number(t):
        t["id"] = count[0]
        count[0] += 1
        for c in t.get("children", []):
            number(c)

    def operand(t):
        if t["kind"] in ("var", "field", "param") and not t.get("children") and t["name"]:
            return t["name"]
        return f'"{t.get("literal")}"' if t["kind"] == "literal" else f"%{t['id']}"

    def visit(t, used, fn):
        kind, kids, line, own = t["kind"], t.get("children", []), t["line"], f"%{t['id']}"
        say = lambda *x, at=line: out.append((fn, *x, at))
        values = [operand(c) for c in kids]
        if kind == "lambda":
            for c in kids:
                visit(c, False, f"{root}/{t['id']}")
        elif kind in ("if", "ternary", "while"):
            for k, c in enumerate(kids):
                if k == 2:
                    say("else", None, None, ())
                visit(c, k > 0 and used, fn)
                if k and used:
                    say("assign", own, None, (operand(c),), at=c["line"])
                if k == 0:
                    say("branch", None, None, (operand(c),))
            say("end", None, None, ())
        elif kind == "case":
            for k, c in enumerate(kids):
                last = k == len(kids) - 1
                if k and not last:
                    say("branch", None, None, ())
                visit(c, k > 0 and used, fn)
                if k and used:
                    say("assign", own, None, (operand(c),), at=c["line"])
                if k and not last:
                    say("else", None, None, ())
            for _ in range(len(kids) - 2):
                say("end", None, None, ())
        else:
            for k, c in enumerate(kids):
                visit(c, kind in TAKES or (kind == "block" and k == len(kids) - 1 and used), fn)
            if kind == "app":
                say("call", None, t["name"], tuple(values))
            if used and (kind in ("app", "binary", "list", "block") or (kind == "field" and kids)):
                say("assign", own, t["name"] if kind == "app" else t.get("op"), tuple(values[-1:] if kind == "block" else values))
            if kind in ("let", "assign") and t["name"]:
                say("assign", t["name"], None, tuple(values))
            if kind == "return":
                say("return", None, None, tuple(values))
            if kind == "try":
                say("call", None, "try", ("%try",))

    root = fn
    number(tree)
    for c in tree["children"]:
        visit(c, False, fn)
    return out


def test_statements_equal_a_recursive_walk(spark):
    rows, want = [], {}
    for seed in range(120):
        r = random.Random(seed)
        tree = {"kind": "function", "name": "f", "line": 1, "children": [{"kind": "param", "name": "p", "line": 1}, {"kind": "block", "name": "", "line": 1, "children": [_tree(r) for _ in range(r.randint(0, 4))]}]}
        rows += exprs.flatten("x", f"fn{seed}", tree)
        for s in _lowered(tree, f"fn{seed}"):
            want.setdefault(s[0], []).append(s[1:])
    il = lowering.lower(spark.createDataFrame(rows, EXPRS))
    got = {}
    for x in il.orderBy("fn", "ord").collect():
        got.setdefault(x["fn"], []).append((x["kind"], x["lhs"], x["callee"], tuple(x["args"]), x["line"]))
    assert got == want
    assert all(cfg.build_blocks([{"kind": k} for k, *_ in s]) for s in got.values())


def test_findings_along_the_flow_of_a_program(spark):
    call = lambda f, a: f'<call_expression srow="{{l}}"><identifier field="function">{f}</identifier><arguments>{a}</arguments></call_expression>'
    var = lambda x: f"<identifier>{x}</identifier>"
    let = lambda x, v: f'<variable_declarator><identifier field="name">{x}</identifier>{v}</variable_declarator>'
    lines = [let("a", call("get_param", "")), f'<if_statement><identifier field="condition">c</identifier><statement_block>{let("a", call("escape", var("a")))}</statement_block></if_statement>', call("exec", var("a")), call("exec", call("escape", var("a"))), call("exec", call("trim", var("a")))]
    body = "".join(x.replace("{l}", str(k)) for k, x in enumerate(lines))
    doc = f'<program><function_declaration><identifier field="name">m</identifier><formal_parameters/><statement_block>{body}</statement_block></function_declaration></program>'
    rules = [{"rule": "R", "pattern": "exec", "match": "exact", "arg": 0, "sanitizers": []}]
    found = cfg.cfg_findings(lowering.lower(_expr(spark, [("f", doc)], "javascript")), rules, ("get_param",), ("escape",)).collect()
    # cleaned on one branch only: still a finding; cleaned in the argument: none; passed through a call: a finding
    assert [(r["rule"], r["line"]) for r in found] == [("R", 3), ("R", 5)]


# -- nested intervals


@pytest.mark.parametrize("seed", range(3))
def test_intervals_equal_comparing_all_rows(spark, seed):
    r = random.Random(seed)
    rows = [row for k in range(6) for row in exprs.flatten("x", f"fn{k}", {"kind": "function", "children": [_tree(r) for _ in range(3)]})]
    df = spark.createDataFrame(rows, EXPRS)
    which = F.col("kind").isin("app", "if", "block")
    around = {(t[1], t[2]): [o[2] for o in rows if o[1] == t[1] and o[12] < t[12] <= o[13] and o[5] in ("app", "if", "block")] for t in rows}
    got = intervals.with_nearest(df, ["file", "fn_id"], which, "a", [F.col("expr_id").alias("up")]).collect()
    assert {(x["fn_id"], x["expr_id"]): (x["a_level"], x["a"] and x["a"]["up"]) for x in got} == {k: (len(v), v[-1] if v else None) for k, v in around.items()}
    pairs = intervals.within(df, ["file", "fn_id"], which, F.col("kind") == "var", [F.col("expr_id").alias("up")]).collect()
    assert sorted((x["fn_id"], x["expr_id"], x["outer"]["up"]) for x in pairs) == sorted((t[1], t[2], o) for t in rows if t[5] == "var" for o in around[t[1], t[2]])
    two = intervals.within(df, ["file", "fn_id"], which, F.lit(True), [F.col("expr_id").alias("up")], 2).collect()
    assert sorted((x["fn_id"], x["expr_id"], x["outer"]["up"]) for x in two) == sorted((t[1], t[2], o) for t in rows for o in around[t[1], t[2]][-2:])
