"""Detectors on hand-written program facts."""

import json

import pytest

from sparkhound.functions import predicates as P
from sparkhound.operators import cfg, changes, matching, reach, scopes, smells, taint
from sparkhound.plans import reports
from sparkhound.schema import NODES
from sparkhound.sources import project
from sparkhound.sources.default_rules import default_sinks
from sparkhound.sources.nodes import read_json_nodes
from sparkhound.sources.rules import load_rules, parse_rules, rule_sources, sink_table


def var(v):
    return ("var", v, "")


def call(v):
    return ("call", v, "")


def lit(v):
    return ("literal", v, "")


def make(spark, rows):
    """rows: (file, line, kind, name, args[, metadata])"""
    full = [(r[0], k, r[1], r[2], r[3], r[4], bool(len(r) > 6 and r[6]), "sample", r[5] if len(r) > 5 else {}) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, NODES)


RULES = """
// two rules
rule "SSRF" severity="High" {
    languages { exclude "other" }
    sinks { sink "HTTP::Client.get" arg=0 { sanitizer "check_ssrf"
            fix "HTTP::Client.get(URI.parse({arg0}))" } }
    sources { source "params" field="url" }
    message "{sink} gets {tainted_vars}"
}
rule "WeakHash" severity="Low" { sinks { sink "$x.md5" } conditions { requires_tainted_args false } message "{sink}" }
rule "NoMode" severity="Medium" { sinks { sink "open" match="exact" } conditions { check_args_missing "mode" } message "no mode" }
"""


def tainted(spark, rows):
    return {(r["file"], r["var"], r["field"]) for r in taint.analyse(make(spark, rows)).collect()}


def test_parameter_to_sink(spark):
    n = make(spark, [("a", 1, "def", "fetch", [var("user_url")]), ("a", 2, "assign", "u", [var("user_url")]), ("a", 3, "call", "HTTP::Client.get", [var("u")]), ("a", 4, "call", "HTTP::Client.get", [lit("x")])])
    found = matching.findings(n, sink_table(spark, RULES), taint.analyse(n)).collect()
    assert [(r["rule"], r["line"], r["message"], r["suggestion"]) for r in found] == [("SSRF", 3, "HTTP::Client.get gets u", "HTTP::Client.get(URI.parse(u))")]


def test_sanitised_assignment_is_clean(spark):
    assert ("a", "s", "") not in tainted(spark, [("a", 1, "def", "f", [var("params")]), ("a", 2, "assign", "s", [call("sanitize.html"), var("params")]), ("a", 3, "assign", "t", [var("s")])])


def test_string_methods_and_receivers(spark):
    got = tainted(spark, [("a", 1, "def", "f", [var("params")]), ("a", 2, "assign", "x", [call("params.strip!")]), ("a", 3, "assign", "y", [call("x.upcase")]), ("a", 4, "assign", "z", [call("clean.upcase")])])
    assert {("a", "x", ""), ("a", "y", "")} <= got and ("a", "z", "") not in got


def test_uri_fields_and_alias(spark):
    got = tainted(spark, [("a", 1, "def", "f", [var("url")]), ("a", 2, "assign", "u", [call("URI.parse"), var("url")]), ("a", 3, "assign", "v", [var("u")])])
    assert ("a", "u", "host") in got and ("a", "v", "host") in got


def test_returns_and_imports(spark):
    rows = [("a", 1, "def", "get", [var("params")]), ("a", 2, "assign", "r", [var("params")]), ("b", 1, "def", "use", []), ("b", 2, "assign", "x", [call("get")]), ("c", 1, "assign", "y", [call("get")])]
    n = make(spark, rows)
    imports = spark.createDataFrame([("b", "a")], "file string, imported_file string")
    got = {(r["file"], r["var"]) for r in taint.analyse(n, imports).collect()}
    assert ("b", "x") in got and ("c", "y") not in got


def test_guards_clear_later_lines_only(spark):
    n = make(spark, [("a", 1, "def", "f", [var("params")]), ("a", 2, "call", "HTTP::Client.get", [var("params")]), ("a", 3, "guard", "if", [var("params")]), ("a", 4, "call", "HTTP::Client.get", [var("params")])])
    found = matching.findings(n, sink_table(spark, RULES), taint.analyse(n), taint.guard_lines(n)).collect()
    assert [r["line"] for r in found] == [2]


def test_calls_are_never_broadcast(spark, monkeypatch):
    n = make(spark, [("a", 1, "def", "f", []), ("a", 2, "call", "Digest.md5", []), ("a", 3, "call", "x.open", [lit("f")]), ("b", 3, "call", "open", [lit("f")])])
    sinks, calls = sink_table(spark, RULES), n.where("node_type = 'call'")
    got = matching.matches(calls, sinks)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == plan.count("rightHint=(strategy=broadcast)") == 2
    monkeypatch.setattr(matching, "FEW", 0)  # beyond it the names are merged, with the same result
    merged = matching.matches(calls, sinks)
    assert "strategy=merge" in merged._jdf.queryExecution().optimizedPlan().toString()
    key = lambda df: sorted((r["file"], r["line"], r["sink_id"]) for r in df.collect())
    assert key(got) == key(merged) != []
    # nor are the scopes of all nodes
    found, none = calls.select("file", "ord"), spark.createDataFrame([], "name string, entry string, hops int")
    tagged = reach.tagged(found, n, none)
    assert "SortMergeJoin" in tagged._jdf.queryExecution().executedPlan().toString()
    assert {(r["file"], r["func"], r["status"]) for r in tagged.collect()} == {("a", "f", "Dormant"), ("b", None, "Dormant")}


def test_validation_scopes(spark):
    n = make(spark, [("a", 1, "def", "f", [var("path")]), ("a", 2, "call", "path.starts_with?", [lit("/")]), ("a", 3, "call", "File.read", [var("path")]), ("a", 4, "call", "File.read", [var("other")]), ("a", 60, "call", "File.read", [var("path")])])
    s = matching.validation_scopes(n)
    assert [(r["kind"], r["var"], r["from_line"], r["to_line"]) for r in s.collect()] == [("check", "path", 2, 52)]
    found = n.where("name = 'File.read'").selectExpr("'PathTraversal' AS rule", "file", "line", "args")
    assert sorted(r["line"] for r in matching.outside_scopes(found, s).collect()) == [4, 60]


def test_scopes_of_checks_take_no_joins(spark):
    n = make(spark, [("a", 1, "def", "f", []), ("a", 2, "call", "require_admin", []), ("a", 9, "def", "g", []), ("a", 9, "def", "h", []), ("a", 9, "call", "require_admin", []), ("a", 12, "def", "i", []), ("a", 13, "call", "require_admin", []), ("b", 1, "call", "require_admin", [])])
    s = matching.validation_scopes(n)
    assert sorted((r["file"], r["from_line"], r["to_line"]) for r in s.collect()) == [("a", 2, 9), ("a", 9, 12), ("a", 13, 213)]
    assert "Join" not in s._jdf.queryExecution().executedPlan().toString()


def test_pattern_kinds_and_conditions(spark):
    n = make(spark, [("a", 1, "call", "Digest.md5", []), ("a", 2, "call", "open", [lit("f")]), ("a", 3, "call", "open", [lit("mode: r")]), ("a", 4, "call", "reopen", [lit("f")]), ("a", 5, "call", "open", [])])
    none = spark.createDataFrame([], "file string, var string, field string")
    assert sorted((r["rule"], r["line"]) for r in matching.findings(n, sink_table(spark, RULES), none).collect()) == [("NoMode", 2), ("WeakHash", 1)]


def test_scopes(spark):
    n = make(spark, [("a", 1, "call", "top", []), ("a", 2, "def", "f", []), ("a", 3, "call", "x", []), ("a", 5, "def", "g", []), ("a", 6, "call", "y", [])])
    assert [(r["func_name"], r["start_line"], r["end_line"]) for r in scopes.function_scopes(n).orderBy("start_line").collect()] == [("f", 2, 4), ("g", 5, scopes.FAR)]
    assert [r["scope_name"] for r in scopes.with_scope(n).orderBy("line").collect()] == [None, "f", "f", "g", "g"]
    assert [r["scope_name"] for r in scopes.with_scope(n, strict=True).orderBy("line").collect()] == [None, None, "f", "f", "g"]


def test_reachability(spark):
    n = make(spark, [("a", 1, "def", "main", []), ("a", 2, "call", "x.step", []), ("a", 3, "def", "step", []), ("a", 4, "call", "last", []), ("a", 5, "def", "last", []), ("a", 6, "call", "step", []), ("a", 7, "def", "lonely", []), ("a", 8, "call", "z", [])])
    edges, entries = reach.call_edges(n), reach.entry_points(n)
    found = reach.reachable(edges, entries)
    assert {r["name"]: r["hops"] for r in found.collect()} == {"main": 0, "step": 1, "last": 2}
    assert {r["name"]: r["path"] for r in reach.paths(found).collect()}["last"] == ["main", "step", "last"]
    hits = n.where("line IN (6, 8)")
    tagged = reach.tagged(hits.select("file", "line", "ord"), n, found)
    assert [(r["line"], r["status"]) for r in tagged.orderBy("line").collect()] == [(6, "Live"), (8, "Dormant")]
    assert [(r["live"], r["dormant"]) for r in reach.heatmap(tagged).collect()] == [(1, 1)]
    classes = reach.classified(edges, entries, edges.limit(0).selectExpr("caller AS name"), found)
    text = reports.dot(edges, classes)
    assert '"main" [color=green];' in text and '"step" -> "last";' in text


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(1)
    links = [(rng.randint(0, 2), rng.randint(0, 60), rng.randint(0, 60)) for _ in range(70)] + [(9, k, k + 1) for k in range(40)]
    got = {(r["g"], r["node"]): r["label"] for r in reach.components(spark.createDataFrame(links, "g int, a int, b int"), "g").collect()}
    label = {(g, x): x for g, a, b in links for x in (a, b)}
    for _ in range(100):
        for g, a, b in links:
            label[g, a] = label[g, b] = min(label[g, a], label[g, b])
    assert got == label


def rules_of(df):
    return {(r["rule"], r["subject"]) for r in df.collect()}


def test_smells(spark):
    big = [("a", 1, "def", "long", [var(f"p{k}") for k in range(6)] + [var("use_x")])] + [("a", k, "call", "o.m", []) for k in range(2, 40)]
    n = make(spark, big + [("b", 1, "control", "case", [lit("12")]), ("b", 2, "control", "a && b || c && d", []), ("b", 3, "call", "a.b.c.d.e", [])])
    got = rules_of(smells.all_smells(n))
    assert {("LongMethod", "long"), ("LongParameterList", "long"), ("FlagArgument", "use_x"), ("ShotgunSurgery", "o"), ("FeatureEnvy", "long -> o"), ("ComplexMatch", "case"), ("ComplexConditional", "a && b || c && d"), ("MessageChain", "a.b.c.d.e")} <= got


def test_dead_code(spark):
    n = make(spark, [("a", 1, "def", "f", []), ("a", 5, "terminator", "return", []), ("a", 6, "call", "x", []), ("b", 1, "def", "g", []), ("b", 4, "control", "if", []), ("b", 5, "terminator", "return", []), ("b", 6, "call", "y", [])])
    assert rules_of(smells.dead_code(n)) == {("DeadCode", "x")}


def test_duplicates_need_four_places_in_two_files(spark):
    block = [("call", "x", [lit("1")]), ("assign", "v", [var("q")])] * 4
    rows = [(f, k + 1, *r[:3]) for f in ("a", "b", "c", "d") for k, r in enumerate(block)]
    got = smells.duplicate_windows(make(spark, rows)).collect()
    assert [(r["n"], r["files"], r["file"], r["line"]) for r in got] == [(4, 4, "a", 1)]
    assert smells.duplicate_windows(make(spark, rows[:24])).count() == 0


def test_concurrency(spark):
    n = make(spark, [("a", 1, "def", "f", []), ("a", 2, "call", "spawn", []), ("a", 3, "call", "ch.send", []), ("a", 4, "call", "d.close", []), ("a", 5, "call", "d.receive", []), ("b", 1, "def", "g", []), ("b", 2, "call", "spawn", []), ("b", 3, "control", "rescue", []), ("b", 4, "call", "e.receive", []), ("b", 5, "call", "e.close", [])])
    assert rules_of(smells.orphaned_spawn(n)) == {("OrphanedSpawn", "f")}
    assert rules_of(smells.muted_pack(n)) == {("MutedPack", "ch")} and rules_of(smells.dead_letter(n)) == {("DeadLetter", "d")}


def classes(spark):
    rows = [("a", 1, "class", "Base", [], {"parent": "", "abstract": "false"}), ("a", 2, "def", "run", []), ("a", 3, "call", "KidA.new", [])]
    for k, name in enumerate(["KidA", "KidB", "KidC"]):
        rows += [("a", 10 + 5 * k, "class", name, [], {"parent": "Base"}), ("a", 11 + 5 * k, "def", "run", []), ("a", 12 + 5 * k, "assign", "@@n", [lit("1")])]
    rows += [("b", 10 * k, "class", f"L{k}", [], {"parent": f"L{k - 1}"} if k > 1 else {}) for k in range(1, 7)]
    rows += [("c", 1, "class", "Lonely", [], {"abstract": "true"}), ("c", 5, "class", "KidABase", [], {}), ("c", 6, "call", "property", []), ("c", 7, "call", "property", [])]
    return make(spark, rows)


def test_hierarchy(spark):
    n = classes(spark)
    c = smells.class_table(n)
    assert rules_of(smells.base_class_should_be_abstract(c)) == {("BaseClassShouldBeAbstract", "Base")}
    assert rules_of(smells.speculative_generality(c)) == {("SpeculativeGenerality", "Lonely")}
    assert rules_of(smells.deep_inheritance(c)) == {("DeepInheritance", "L5"), ("DeepInheritance", "L6")}
    assert rules_of(smells.refused_bequest(c, n)) == {("RefusedParentBequest", f"Kid{k}.run") for k in "ABC"}
    assert rules_of(smells.knows_derived(c, n)) == {("BaseClassKnowsDerivedClass", "Base")}
    assert rules_of(smells.parallel_inheritance(c)) == {("ParallelInheritance", "KidABase")}
    assert rules_of(smells.anti_singleton(n)) == {("AntiSingleton", f"Kid{k}.@@n") for k in "ABC"}
    assert rules_of(smells.data_class(n, c)) == {("DataClass", "KidABase")}


def test_ancestors_survive_cycles(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "a")], "name string, parent string")
    assert sorted(tuple(r) for r in reach.ancestors(c).collect()) == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2)]


def test_lcom4(spark):
    rows = [("k", "m1", "x"), ("k", "m2", "x"), ("k", "m3", "y"), ("k", "m4", "z")]
    assert [tuple(r) for r in smells.lcom4(spark.createDataFrame(rows, "class string, method string, field string")).collect()] == [("k", 2)]


def step(kind, lhs=None, callee=None, args=(), line=0):
    return {"kind": kind, "lhs": lhs, "callee": callee, "args": list(args), "line": line}


SHELL = [{"rule": "Cmd", "pattern": "system", "match": "exact", "arg": None, "sanitizers": []}]


@pytest.mark.parametrize(
    ("rows", "lines"),
    [
        ([step("assign", "x", args=["params"]), step("call", callee="system", args=["x"], line=2)], [2]),
        ([step("branch"), step("assign", "x", args=["params"]), step("end"), step("call", callee="system", args=["x"], line=4)], [4]),
        ([step("call", callee="validate", args=["params"]), step("branch"), step("call", callee="system", args=["params"], line=3), step("end")], []),
        ([step("branch"), step("call", callee="validate", args=["params"]), step("end"), step("call", callee="system", args=["params"], line=4)], [4]),
        ([step("branch"), step("return"), step("call", callee="system", args=["params"], line=3), step("end")], []),
        ([step("assign", "x", args=["params"]), step("assign", "x", callee="sanitize"), step("call", callee="system", args=["x"], line=3)], []),
    ],
)
def test_control_flow(rows, lines):
    assert [f[1] for f in cfg.analyse_function(rows, ["params"], SHELL, ("params",), ("validate", "sanitize"))] == lines


def test_dominators_and_limit():
    blocks, succ = cfg.build_blocks([step("branch"), step("else"), step("end")])
    assert cfg.dominators(succ)[3] == {0, 3} and len(blocks) == 4
    assert cfg.analyse_function([step("branch"), step("end")] * 300, [], SHELL, (), ()) == [("", 0, "", "skipped")]


def test_rule_files(tmp_path):
    rows = parse_rules(RULES)
    assert [(r["rule"], r["pattern"], r["arg"], r["langs_out"]) for r in rows][0] == ("SSRF", "HTTP::Client.get", 0, ["other"])
    assert rule_sources(RULES) == [("SSRF", "params", "url")]
    (tmp_path / "b.kdl").write_text(RULES)
    (tmp_path / "a.kdl").write_text("{ broken")
    text, warnings = load_rules(str(tmp_path))
    assert len(parse_rules(text)) == 3 and len(warnings) == 1 and load_rules(str(tmp_path / "none"), "d") == ("d", [])


def test_default_rules(spark):
    n = make(spark, [("a", 1, "def", "f", [var("params")]), ("a", 2, "call", "db.query", [var("params")]), ("a", 3, "call", "Digest::MD5.new", []), ("a", 4, "call", "Regex.new", [lit("(a+)+")]), ("a", 5, "call", "HTTP::Client.new", [lit("h")]), ("a", 6, "call", "system", [lit("ls")])])
    found = matching.findings(n, default_sinks(spark), taint.analyse(n)).collect()
    assert sorted((r["rule"], r["line"]) for r in found) == [("MissingTimeout", 5), ("ReDoS", 4), ("SQLInjection", 2), ("WeakCryptography", 3)]


def test_project_files(spark, tmp_path):
    for f in ("src/a.cr", "src/b.svelte.ts", "lib/dep/c.cr", "node_modules/x.js", ".git/h.cr", "d.txt", "e.nim"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    got = [(r["path"], r["lang"]) for r in project.discover(spark, str(tmp_path)).collect()]
    assert got == [("e.nim", "nim"), ("lib/dep/c.cr", "crystal"), ("src/a.cr", "crystal")]  # without a manifest lib is like any folder
    (tmp_path / "shard.yml").write_text("name: x")
    found = project.discover(spark, str(tmp_path))
    assert [(r["path"], r["lang"]) for r in found.collect()] == [("e.nim", "nim"), ("src/a.cr", "crystal")]
    assert [tuple(r) for r in project.language_counts(project.discover(spark, str(tmp_path), include_deps=True)).collect()] == [("crystal", 2), ("nim", 1)]
    assert project.discover(spark, str(tmp_path), ["crystal"], include_deps=True).select("dependency_name").where("is_dependency").first()[0] == "dep"
    conf = project.load_config('[analysis]\ncfg = true\n[claws.suppress]\nLongMethod = ["src/**"]\n', {"scan": {"path": "x"}})
    assert conf["analysis"]["cfg"] and conf["suppress"] == {"LongMethod": ["src/**"]} and conf["scan"]["path"] == "x"
    assert project.shard_manifest("dependencies:\n  kemal:\n    github: kemalcr/kemal\n    version: 1.0\n  db:\n    version: 2\n") == [("kemal", "kemalcr/kemal", "1.0"), ("db", None, "2")]
    assert project.nimble_manifest('requires "nim >= 1.0"\nrequires "jester", "chronos >= 3.0"\nrequires "https://x.y/z.git"') == [("jester", None, None), ("chronos", None, "3.0"), ("z", "https://x.y/z.git", None)]


def test_json_nodes(spark, tmp_path):
    rows = [{"type": "def", "name": "f", "args": [{"arg_type": "var", "value": "x"}], "line": 1, "taint": False, "file": "a"}, {"node_type": "odd", "name": "g", "args": [], "line": 2, "taint": True, "file": "a", "metadata": {"scent": "true"}}, {"line": 3}]
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, rows)))
    got = read_json_nodes(spark, str(tmp_path / "n.json")).orderBy("ord").collect()
    assert [(r["node_type"], r["name"], r["language"]) for r in got] == [("def", "f", ""), ("call", "g", "")] and got[0]["args"][0]["field"] == "" and got[1]["metadata"] == {"scent": "true"}


def test_reports(spark):
    n = make(spark, [("a", 1, "def", "f", [var("params")]), ("a", 2, "call", "HTTP::Client.get", [var("params")])])
    found = matching.findings(n, sink_table(spark, RULES), taint.analyse(n))
    assert json.loads(reports.json_report(found, 1))["summary"] == {"Error": 1, "Warning": 0, "Info": 0}
    s = json.loads(reports.sarif(found))["runs"][0]
    assert s["results"][0]["level"] == "error" and s["tool"]["driver"]["rules"] == [{"id": "SSRF"}]
    assert "## SSRF (High)" in reports.markdown(found) and reports.terminal(found)[1] == 1
    assert json.loads(reports.rule_list(sink_table(spark, RULES)))["by_severity"] == {"High": 1, "Low": 1, "Medium": 1}


def test_suppression_and_globs(spark):
    f = spark.createDataFrame([("A", "src/x/y.cr"), ("A", "z.cr"), ("B", "z.cr")], "rule string, file string")
    got = f.where(~P.suppressed(f.rule, f.file, {"A": ["src/**"], "B": []})).collect()
    assert [tuple(r) for r in got] == [("A", "z.cr")]


def test_supply_chain(spark):
    bodies = spark.createDataFrame([("a", '{"vulns":[{"id":"1","severity":"HIGH"}]}'), ("b", None), ("c", "{}")], "name string, body string")
    adv = project.advisories(bodies)
    deps = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "name string, version string")
    stale = spark.createDataFrame([("c", "warning")], "name string, level string")
    assert [(r["name"], r["level"]) for r in changes.audit(deps, adv, stale).collect()] == [("a", "critical"), ("c", "warning"), ("b", "clean")]


def test_change_stream(spark, tmp_path):
    from sparkhound.streaming import feed

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, [{"path": "a", "lang": "x", "cksum": "1", "mtime": 1.0}, {"path": "b", "lang": "x", "cksum": "1", "mtime": 1.0}])))
    q = feed.change_stream(feed.watch(spark, str(source))).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (source / "2.json").write_text("\n".join(map(json.dumps, [{"path": "a", "lang": "x", "cksum": "2", "mtime": 2.0}, {"path": "b", "lang": "x", "cksum": None, "mtime": 2.0}])))
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[:2] for r in spark.table("changes").collect()) == [("a", "added"), ("a", "modified"), ("b", "added"), ("b", "removed")]


def test_components_by_group_make_no_rounds(spark, monkeypatch):
    """Groups of ordinary size are gone through once; larger ones, joined in rounds, give the same labels."""
    import random

    rng = random.Random(4)
    links = [(rng.randrange(6), f"m{rng.randrange(40)}", f"f{rng.randrange(40)}") for _ in range(150)] + [(None, "a", "b"), (1, None, "b"), (1, "q", None)]
    df = spark.createDataFrame(links, "g int, a string, b string")
    want = sorted(map(tuple, reach.components(df, "g", large=0).collect()))
    some = sorted(map(tuple, reach.components(df, "g", large=24).collect()))
    monkeypatch.setattr(reach, "durable", None)
    got = sorted(map(tuple, reach.components(df, "g").collect()))
    assert got == want == some and len({label for _, _, label in got}) > 1
