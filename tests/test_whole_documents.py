"""Analyses of a document in the task that parses it give what the operators give for rows in tables, and shuffle nothing more."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_sizes import ODD, SF, _plan
from test_syntax_trees import _tree

from sparkhound import tree_queries
from sparkhound.operators import cfg, exprs, lowering, trees, types
from sparkhound.operators import documents as whole
from sparkhound.plans.fixpoint import durable
from sparkhound.schema import EXPRS
from sparkhound.sources.return_types import return_types
from sparkhound.sources.tree_rules import tree_rules

CALLED = {"f": "result", "h": "nullable", "exec": "result", "open": "nullable"}


@pytest.fixture(scope="module")
def data(spark):
    """(expression rows, the same by file as documents have them): random trees, also outside of functions, and contracted documents."""
    rows = []
    for seed in range(80):
        r = random.Random(seed)
        rows += exprs.flatten(f"x{seed}", "fn", {"kind": "function", "name": "f", "line": 1, "children": [{"kind": "param", "name": "a", "line": 1}, {"kind": "block", "line": 1, "children": [_tree(r) for _ in range(r.randint(0, 4))]}]})
        rows += exprs.flatten(f"x{seed}", "", {"kind": r.choice(["class", "module", "let"]), "name": "c", "line": 1, "children": [_tree(r) for _ in range(r.randint(0, 2))]})
    docs = spark.createDataFrame([(f"{n}{lang}", c, lang) for n, c in ODD for lang in ("gleam", "javascript", "unknown")], "file string, content string, language string")
    docs = docs.unionByName(tree_queries.documents(spark, SF).where("pmod(xxhash64(file), 10) = 0"))
    rows += [tuple(r) for r in trees.document_expressions(docs, tree_rules(spark)).drop("language").collect()]
    files = {}
    for r in rows:
        files.setdefault(r[0], []).append(r[1:])
    return durable(spark.createDataFrame(rows, EXPRS)), files


def _once(plan):
    """One shuffle, that of the fixture's documents; no table is kept on the way."""
    return plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Window" not in plan and "Join" not in plan


def test_forms(spark, data):
    want = Counter(r["hash"] for r in exprs.duplicate_trees(data[0].withColumn("line", F.col("expr_id").cast("int"))).where("files >= 4").collect() for _ in range(r["files"]))
    got = Counter(h.hex() for rows in data[1].values() for h in set().union(*map(whole.forms, whole.trees(rows))))
    assert want and {h: n for h, n in got.items() if n >= 4} == want
    plan = _plan(tree_queries.tree_duplicates(spark, SF))
    assert plan.count("Exchange") == 2 and plan.count("FileScan") == 1 and "Window" not in plan  # documents, then counts by hash


def test_flow_findings(spark, data):
    rules = [{"rule": "A", "pattern": "exec", "match": "exact", "arg": 0, "sanitizers": []}, {"rule": "B", "pattern": "g", "match": "part", "arg": None, "sanitizers": ["b"]}]
    for limit in (500, 6):
        want = cfg.cfg_findings(lowering.lower(data[0]), rules, ("a", "f", "get_param", "user_"), ("escape", "h"), lowering.parameters(data[0]), limit).collect()
        got = [(file, *f) for file, rows in data[1].items() for f in whole.flow_findings(rows, rules, ("a", "f", "get_param", "user_"), ("escape", "h"), limit)]
        assert {"finding", "skipped"} >= {r["status"] for r in want} and want and Counter(map(tuple, want)) == Counter(got)
    assert _once(_plan(tree_queries.tree_flow_findings(spark, SF)))


def test_lint(spark, data):
    e = data[0].withColumn("language", F.lit("x"))
    known = durable(types.kinds(e, return_types(spark, {"x": {k: [n for n, of in CALLED.items() if of == k] for k in CALLED.values()}}), F.col("language")))
    kind, name = F.col("kind"), F.col("name")
    names = spark.createDataFrame([("n", "Hint", x, "") for x in ("f", "a.b", "exec")], "rule string, severity string, name string, hint string")
    want = [
        types.ignored_results(e, known), types.unchecked_nullables(e, known), exprs.name_lookup(e, names), exprs.shape(e, kind == "binary", F.col("c_kind") == "literal", "s", "Hint"),
        exprs.count_over(e, kind == "app", 2, "c", "Hint"), exprs.literal_match(e, F.col("literal") == "1", "l", "Hint"), exprs.followed_by(e, name == "f", name == "g.h", "p", "Hint"),
        exprs.nested_deeper(e, kind == "block", 2, "d", "Hint"), exprs.unused_bindings(e), exprs.shadowed(e),
    ]
    got = [[] for _ in want]
    for file, rows in data[1].items():
        for t in whole.trees(rows):
            k = whole.value_kinds(t, CALLED)
            found = (
                whole.ignored_results(t, k), whole.unchecked_nullables(t, k), whole.name_lookup(t, {"f": "n", "a.b": "n", "exec": "n"}), whole.shape(t, lambda r: r[whole.KIND] == "binary", lambda r: r[whole.KIND] == "literal", "s"),
                whole.count_over(t, lambda r: r[whole.KIND] == "app", 2, "c"), whole.literal_match(t, lambda x: x == "1", "l"), whole.followed_by(t, "f", "g.h", "p"), whole.nested_deeper(t, "block", 2, "d"), whole.unused_bindings(t), whole.shadowed(t),
            )
            for out, hits in zip(got, found, strict=True):
                out += [(rule, file, subject) for rule, subject in hits]
    for w, g in zip(want, got, strict=True):
        assert Counter((r["rule"], r["file"], r["subject"]) for r in w.collect()) == Counter(g)
    assert [len(g) > 0 for g in got] == [True] * len(got)
    assert _once(_plan(tree_queries.tree_lint(spark, SF)))


def test_statements(spark, data):
    want = Counter((r["file"], r["fn"], r["ord"], r["kind"], r["lhs"], r["callee"], tuple(r["args"]), r["line"]) for r in lowering.lower(data[0]).collect())
    got = Counter()
    for file, rows in data[1].items():
        for t in whole.trees(rows):
            got.update((file, fn, k, *s[:3], tuple(s[3]), s[4]) for fn, il in whole.statements(t).items() for k, s in enumerate(il, 1))
    assert got == want and any("/" in x[1] for x in got)
    assert _once(_plan(tree_queries.tree_statements(spark, SF)))


def test_value_kinds(spark, data):
    returns = return_types(spark, {"x": {k: [n for n, of in CALLED.items() if of == k] for k in CALLED.values()}})
    want = Counter(map(tuple, types.kinds(data[0], returns, F.lit("x")).collect()))
    got = Counter((file, r[whole.FN], r[whole.ID], k) for file, rows in data[1].items() for t in whole.trees(rows) for r, k in zip(t, whole.value_kinds(t, CALLED), strict=True) if k)
    assert got == want and {k[3] for k in got} == {"safe", "nullable", "result", "unknown"}
    assert _once(_plan(tree_queries.tree_value_kinds(spark, SF)))


def test_plain_reading_equals_the_xml_reader(spark):
    rules = trees._held(tree_rules(spark))
    leaf = "<let><identifier field='pattern'>a</identifier>{}</let>"
    plain = [leaf.format(x) for x in ("", " x <integer>1</integer> y ", "<identifier\tfield = 'name'/>".replace(" =", "=").replace("= ", "="), "<block/>t<block></block >", "<identifier srow='4'>ä   </identifier>", "<string>a > b</string>", "<block field=''/>")] + [" \n<a>x</a>\n ", *(c for _, c in ODD[4:])]
    odd = [leaf.format(x) for x in ("&amp;", "&none;", "<![CDATA[<q>]]>", "<!-- <q> -->", "<?p q?>", "]]>", "<a b='1' b='2'/>", "<a b='>'/>", "<a:b xmlns:a='u'>x</a:b>", "<a></b>", "<a><b></a></b>", "<a", "< a/>", "<a/", "a\r\nb", "\x01", "</a>", "<a b=1/>", "<a b='1'c='2'/>", "<ä>x</ä>", "<a b='x\ny'/>")]
    odd += ["<?xml version='1.0' encoding='latin-1'?><identifier>ä</identifier>", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>", "<a/><b/>", "<a/>x", "x<a/>", "﻿<identifier>a</identifier>", "<identifier>a", "", "x", "<>", "</>"]
    for language in ("gleam", "javascript"):
        known = {}
        for doc in plain + odd:
            for _ in range(2):  # unknown tags, then remembered ones
                want = [(up, trees._resolved(tag, field, rules[language]), own, line or 0, at == end) for at, up, _, _, _, end, tag, field, own, line, *_ in tree_queries.parse(doc)[0]]
                assert trees._contract(trees._document_nodes(doc, rules[language], known)) == trees._contract(want), doc
                assert [(*n[:2], n[2].strip(), *n[3:]) for n in trees._document_nodes(doc, rules[language], known)] == want, doc
            assert (trees._plain_nodes(doc, rules[language], known) is None) == (doc in odd), doc
    assert all(len(trees._plain_nodes(f"<x>{'<a>' * 3}{k}{'</a>' * 3}</x>", rules["gleam"], known)) == 4 for k in range(trees.TAGS + 9)) and len(known) <= trees.TAGS
