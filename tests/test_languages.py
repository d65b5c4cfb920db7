"""A language that a project adds goes from tree to lint and imports by its rows alone; taint by name; import paths."""

import posixpath

import pytest
from pyspark.sql import functions as F

from sparkhound.operators import imports, statics, taint, trees, types
from sparkhound.schema import NODES
from sparkhound.sources.languages import Language, Registry
from sparkhound.sources.xml_trees import xml_trees

TOY = Language("toy", ("ty",), (("fn", None, "function", None, None), ("id", "name", None, "name", None), ("call", None, "app", None, None), ("*", "callee", None, "name", None), ("seq", None, "block", None, None)), (".ty",), {"result": ["risky"]})


def _nodes(spark, rows):
    full = [(f, k, line, kind, name, [(t, v, fld) for t, v, fld in args], False, lang, {}) for k, (f, line, kind, name, args, lang) in enumerate(rows)]
    return spark.createDataFrame(full, NODES)


def test_an_added_language(spark):
    r = Registry(TOY)
    call = '<call><x field="callee"><id>{}</id></x></call>'
    doc = f'<fn><id field="name">f</id><seq>{call.format("risky")}{call.format("safe")}{call.format("risky")}</seq></fn>'
    paths = spark.createDataFrame([("a/b.ty", doc), ("c.cr", None)], "file string, content string").withColumn("language", r.of(F.col("file")))
    assert [x["language"] for x in paths.orderBy("file").collect()] == ["toy", "crystal"]
    rows = xml_trees(paths.where("language = 'toy'")).withColumn("language", F.lit("toy"))
    e = trees.expressions(rows, r.tree_rules(spark))
    known = types.kinds(e, r.return_types(spark), F.lit("toy"))
    assert [(x["rule"], x["subject"]) for x in types.ignored_results(e, known).collect()] == [("ignored-result", "risky")]
    n = _nodes(spark, [("a/b.ty", 1, "import", "use", [("literal", "../c/d", "")], "toy"), ("c/d.ty", 1, "def", "g", [], "toy")])
    assert [tuple(x) for x in imports.resolved_imports(n, n, r.import_suffixes()).collect()] == [("a/b.ty", "c/d.ty")]


@pytest.mark.parametrize("path", ["a/b/../c", "./a//b/./c", "a/../../b", "../../x", "/a/../../b", "a/..", "/", "a/b/..//../c/./d", ""])
def test_paths_are_normalised(spark, path):
    got = spark.range(1).select(imports.normalized(F.lit(path)).alias("p")).first()["p"]
    want = posixpath.normpath(path) if path else ""
    assert got == ("" if want == "." else want)


def test_imports_take_the_first_file_that_exists(spark):
    files = spark.createDataFrame([("src/h.cr",), ("src/h/index.cr",), ("lib/k/index.cr",), ("m.js",)], "file string")
    rows = [
        ("src/a.cr", 1, "import", "require", [("literal", "./h", "")], "crystal"), ("src/a.cr", 2, "import", "require", [("literal", "../lib/k", "")], "crystal"), ("src/a.cr", 3, "import", "require", [("literal", "json", "")], "crystal"),
        ("src/a.cr", 4, "import", "require", [("literal", "./none", "")], "crystal"), ("src/a.cr", 5, "import", "require", [("var", "./h", "")], "crystal"), ("src/a.js", 1, "import", "import", [("literal", "../m.js", "")], "javascript"), ("src/a.cr", 6, "import", "require", [], "crystal"),
    ]
    got = sorted(map(tuple, imports.resolved_imports(_nodes(spark, rows), files).collect()))
    assert got == [("src/a.cr", "lib/k/index.cr"), ("src/a.cr", "src/h.cr"), ("src/a.js", "m.js")]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "file string, imported_file string")
    assert sorted(map(tuple, imports.reexported(ring).collect())) == [(x, y) for x in "abc" for y in "abc" if x != y] + [("d", y) for y in "abc"]


def test_taint_by_name_is_an_option(spark):
    n = _nodes(spark, [("a", 1, "assign", "x", [("call", "params.get", "")], "l"), ("b", 1, "assign", "y", [("var", "x", "")], "l"), ("c", 1, "assign", "z", [("var", "y", "")], "l")])
    seen = lambda **how: sorted((r["file"], r["var"]) for r in taint.analyse(n, **how).collect())
    assert seen() == [("a", "x")] and seen(by_name=True) == [("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("c", "z")]


def test_static_statements(spark):
    lit, var = lambda v="s": [("literal", v, "")], lambda v: [("var", v, "")]
    rows = [
        ("assign", "a", lit()), ("assign", "b", var("a")), ("assign", "c", var("b")), ("assign", "c", [("call", "get", "")]), ("assign", "d", var("c")), ("assign", "r", var("s")), ("assign", "s", var("r")), ("assign", "u", var("nowhere")), ("def", "f", var("p")), ("assign", "q", var("p")),
        ("call", "db.query", lit()), ("call", "db.query", var("b")), ("call", "db.query", var("d")), ("call", "db.exec", [("var", "d", ""), ("var", "x", "args")]), ("call", "query", lit()), ("call", "db.other", lit()), ("call", "db.query", [("unknown", "<expr:>", "")]), ("call", "db.query", [("unknown", "<expr:a>", ""), ("var", "a", "")]), ("call", "db.query", []),
    ]
    n = _nodes(spark, [("f", k, kind, name, args, "l") for k, (kind, name, args) in enumerate(rows)])
    assert sorted(r["var"] for r in statics.static_variables(n).collect()) == ["a", "b", "r", "s"]
    said = {r["ord"] for r in statics.with_parameterized(n).where("metadata['parameterized_query'] = 'true'").collect()}
    assert said == {10, 11, 13, 16} and statics.with_parameterized(n).count() == len(rows)
    assert statics.with_parameterized(n.limit(0)).count() == 0


def test_kinds_of_values_equal_a_fold(spark):
    """Random programs: kinds by following bindings in order."""
    import random

    from sparkhound.operators.exprs import flatten
    from sparkhound.schema import EXPRS
    from sparkhound.sources.return_types import return_types

    def tree(r, depth=0):
        kind = r.choice(["var", "literal", "app", "let", "if", "block", "binary", "case"] if depth < 3 else ["var", "literal", "app"])
        kids = [tree(r, depth + 1) for _ in range({"let": 1, "if": r.choice([2, 3]), "block": 2, "binary": 2, "case": 3, "app": 1 if depth < 3 else 0}.get(kind, 0))]
        return {"kind": kind, "name": r.choice("ab") if kind in ("var", "let") else r.choice(["n", "s", "m.e", "zz"]) if kind == "app" else "", "literal_kind": r.choice(["int", "null"]) if kind == "literal" else None, "children": kids}

    table = {"n": "nullable", "s": "safe", "e": "result"}
    rows, want = [], {}
    for seed in range(60):
        r = random.Random(seed)
        t = {"kind": "function", "name": "f", "children": [tree(r) for _ in range(3)]}
        own = flatten("x", f"fn{seed}", t)
        rows += own
        kids = {}
        for x in own:
            kids.setdefault(x[3], []).append(x)
        last, sets = {}, {}
        order = sorted(own, key=lambda x: x[2])
        source = {}
        for x in order:  # bindings seen so far, by position
            if x[5] == "var":
                source[x[2]] = last.get(x[6])
            if x[5] == "let":
                last[x[6]] = x[2]
        changed = True
        while changed:
            changed = False
            for x in order:
                own_kids = kids.get(x[2], [])
                k = x[5]
                new = {
                    "literal": {"nullable" if x[7] == "null" else "safe"}, "binary": {"safe"}, "app": {table.get(x[6].split(".")[-1], "unknown")}, "var": sets.get(source.get(x[2]), set()) if source.get(x[2]) is not None else {"unknown"},
                    "let": sets.get(own_kids[-1][2], set()) if own_kids else set(), "block": sets.get(own_kids[-1][2], set()) if own_kids else set(),
                    "if": set().union(*(sets.get(c[2], set()) for c in own_kids[1:])) | ({"nullable"} if len(own_kids) == 2 else set()), "case": set().union(*(sets.get(c[2], set()) for c in own_kids[1:])),
                }.get(k, set())
                if new - sets.get(x[2], set()):
                    sets[x[2]] = sets.get(x[2], set()) | new
                    changed = True
        for e, s in sets.items():
            if s:
                want[f"fn{seed}", e] = next(iter(s)) if len(s) == 1 else "nullable" if s <= {"safe", "nullable"} else "unknown"
    got = types.kinds(spark.createDataFrame(rows, EXPRS), return_types(spark, {"l": {"nullable": ["n"], "safe": ["s"], "result": ["e"]}}), F.lit("l"))
    assert {(x["fn_id"], x["expr_id"]): x["value"] for x in got.collect()} == want
