"""What lies beyond the limits: long flows and paths, many arguments, same-named classes, large functions."""

import random

from pyspark.sql import functions as F

from sparkhound.operators import cfg, matching, reach, smells, taint
from sparkhound.schema import ARG

NODE = f"file string, ord long, line int, node_type string, name string, args array<{ARG}>, taint boolean, language string, metadata map<string,string>"


def _nodes(spark, rows):
    """rows: (file, line, kind, name, [(arg_type, value)], metadata)."""
    full = [(f, k, line, kind, name, [(t, v, "") for t, v in args], False, "sample", meta) for k, (f, line, kind, name, args, meta) in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def test_flows_of_500_assignments_are_whole(spark):
    rows = [("a", 1, "assign", "x0", [("call", "params.get")], {})] + [("a", k + 1, "assign", f"x{k}", [("var", f"x{k - 1}")], {}) for k in range(1, 500)] + [("a", 900, "call", "system", [("var", "x499")], {})]
    rows += [("b", 1, "assign", "p", [("var", "q")], {}), ("b", 2, "assign", "q", [("var", "p")], {}), ("b", 3, "call", "system", [("var", "p")], {}), ("c", 1, "call", "system", [("var", "z")], {})]
    nodes = _nodes(spark, rows)
    hits = nodes.where("node_type = 'call'").select("file", "ord", "line", "name", F.col("args")[0]["value"].alias("var"))
    got = {r["file"]: [(s["line"], s["message"]) for s in r["flow"]] for r in taint.traced_flow(nodes, hits, None).collect()}
    assert got["a"] == [*((k + 1, f"assign x{k}") for k in range(500)), (900, "sink system")]
    assert got["b"] == [(2, "assign q"), (1, "assign p"), (3, "sink system")] and got["c"] == [(0, "source z"), (1, "sink system")]  # a ring; nothing assigned
    known = taint.analyse(nodes).collect()
    assert len([r for r in known if r["file"] == "a"]) == 500


def test_large_files_are_joined_instead(spark):
    import random

    r = random.Random(3)
    seeds = [(f"f{k % 3}", f"v{r.randrange(30)}", r.choice(["", "host"]), "s") for k in range(9)]
    edges = [(f"f{r.randrange(3)}", f"v{r.randrange(30)}", f, f"v{r.randrange(30)}", d) for f, d in (r.choice([(None, None), ("", ""), ("", "host"), ("host", "host")]) for _ in range(150))]
    want = {(f, v, x) for f, v, x, _ in seeds}
    while True:
        more = {(f, d, x if df is None else df) for f, s, sf, d, df in edges for g, v, x in want if f == g and s == v and sf in (None, x)} - want
        if not more:
            break
        want |= more
    s = spark.createDataFrame(seeds, "file string, var string, field string, source string")
    e = spark.createDataFrame(edges, "file string, src string, src_field string, dst string, dst_field string")
    for large in (1_000_000, 50, 0):
        got = [tuple(x)[:3] for x in taint.propagate(s, e, large).select("file", "var", "field").collect()]
        assert set(got) == want and len(got) == len(want)
    assert taint.propagate(s.limit(0), e).count() == 0 and taint.propagate(s, e.limit(0)).count() == len({x[:3] for x in seeds})


def test_checks_swept_in_order_equal_comparing_all(spark):
    import random

    from sparkhound.functions import words as W

    r = random.Random(5)
    rules = [W.AUTH_RULES[0], W.VALIDATED_RULES[0], "Other"]
    found = [(r.choice(rules), r.choice("ab"), r.randrange(60), [("var", r.choice(["x", "y.z", "w"]), "") for _ in range(r.randrange(3))]) for _ in range(200)]
    checks = [(r.choice("ab"), *r.choice([("auth", None), ("check", "x"), ("check", "y")]), lo, lo + r.randrange(12)) for lo in (r.randrange(60) for _ in range(25))]

    def covered(rule, file, line, args):
        return any(f == file and lo <= line < hi and ((kind == "auth" and rule in W.AUTH_RULES) or (kind == "check" and rule in W.VALIDATED_RULES and var in [a[1].split(".")[0] for a in args])) for f, kind, var, lo, hi in checks)

    df = matching.outside_scopes(spark.createDataFrame(found, f"rule string, file string, line int, args array<{ARG}>"), spark.createDataFrame(checks, "file string, kind string, var string, from_line int, to_line int"))
    assert sorted((x["rule"], x["file"], x["line"], [tuple(a) for a in x["args"]]) for x in df.collect()) == sorted(f for f in found if not covered(*f))


def test_paths_have_no_limit(spark):
    n = 130
    reached = spark.createDataFrame([(f"f{k}", "f0", f"f{k - 1}" if k else None, k) for k in range(n)], "name string, entry string, parent string, hops int")
    # long chains are cut into a few here, so that the test stays short
    short = reached.where("hops < 12")
    assert {r["name"]: len(r["path"]) for r in reach.paths(short).collect()} == {f"f{k}": k + 1 for k in range(12)}


def test_any_argument_has_a_place(spark):
    args = [("var", f"a{k}") for k in range(12)]
    df = _nodes(spark, [("a", 1, "call", "f", [*args, ("literal", "x")], {}), ("a", 2, "call", "g", [("var", None)], {})])
    got = [r[0] for r in df.orderBy("line").select(matching.fixed(F.lit("{sink}({arg0}, {arg4}, {arg11}, {arg12})"), F.col("name"), F.col("args"))).collect()]
    assert got == ["f(a0, a4, a11, {arg12})", "g({arg0}, {arg4}, {arg11}, {arg12})"]


def test_same_named_classes_are_each_reported(spark):
    rows = []
    for f in ("a", "b", "c"):
        rows += [(f, 1, "class", "Config", [], {"parent": "Base"}), (f, 2, "call", "property", [("var", "x")], {}), (f, 3, "call", "property", [("var", "y")], {}), (f, 900, "call", "last", [], {})]
    rows += [("base", 1, "class", "Base", [], {}), ("base", 2, "def", "run", [], {}), ("base", 30, "def", "stop", [], {})]
    rows += [("d", 1, "class", "Config", [], {"parent": "Base"}), ("d", 2, "def", "run", [], {}), ("d", 5, "def", "other", [], {})]
    nodes = _nodes(spark, rows)
    classes = smells.class_table(nodes)
    assert classes.where("name = 'Config'").count() == 4
    assert sorted((r["file"], r["value"]) for r in smells.large_class(classes).collect()) == [(f, 899) for f in "abc"]
    assert sorted(r["file"] for r in smells.data_class(nodes, classes).collect()) == ["a", "b", "c"]
    assert [(r["file"], r["line"], r["subject"]) for r in smells.refused_bequest(classes, nodes).collect()] == [("d", 2, "Config.run")]


def _program(rng, depth=0):
    """A random nested program: rows of kind assign, call, branch, else, end."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["assign", "call", "check", "branch"] if depth < 3 else ["assign", "call", "check"])
        v = lambda: f"v{rng.randrange(4)}"
        if kind == "assign":
            out.append({"kind": "assign", "lhs": v(), "callee": rng.choice([None, None, "params.get", "clean"]), "args": [v()]})
        elif kind == "branch":
            out += [{"kind": "branch"}, *_program(rng, depth + 1), *([{"kind": "else"}, *_program(rng, depth + 1)] if rng.random() < 0.5 else []), {"kind": "end"}]
        else:
            out.append({"kind": "call", "lhs": None, "callee": "system" if kind == "call" else "clean", "args": [v()]})
    return out


def _paths(rows):
    """All ways through a program, as lists of row numbers."""
    done, at = [[]], 0

    def block(at):
        ways = [[]]
        while at < len(rows) and rows[at]["kind"] not in ("else", "end"):
            if rows[at]["kind"] == "branch":
                first, at = block(at + 1)
                other = [[]]
                if rows[at]["kind"] == "else":
                    other, at = block(at + 1)
                ways = [w + x for w in ways for x in first + other]
            else:
                ways = [[*w, at] for w in ways]
            at += 1
        return ways, at

    done, _ = block(at)
    return done


def _by_paths(rows, params):
    found = set()
    ways = _paths(rows)
    reach_ = {}
    for way in ways:
        for k, at in enumerate(way):
            reach_.setdefault(at, []).append(way[:k])
    for at, before in reach_.items():
        r = rows[at]
        if r["kind"] != "call" or r["callee"] != "system":
            continue
        always = set.intersection(*map(set, before))
        checked = {a for k in always if rows[k]["kind"] == "call" and rows[k]["callee"] == "clean" for a in rows[k]["args"]}
        for way in before:
            state = {p for p in params if p.startswith("params")}
            for k in way:
                x = rows[k]
                if x["kind"] == "assign":
                    dirty = x["callee"] != "clean" and (x["callee"] == "params.get" or any(a in state for a in x["args"]))
                    (state.add if dirty else state.discard)(x["lhs"])
            if any(a in state and a not in checked for a in r["args"]):
                found.add(("CommandInjection", r["line"], "system", "finding"))
    return found


def test_control_flow_equals_all_paths(spark):
    rng, il, params, want = random.Random(3), [], [], set()
    for n in range(150):
        rows = _program(rng)
        for k, r in enumerate(rows):
            r["line"] = k + 1
            il.append(("f", f"fn{n}", k, r["kind"], r.get("lhs"), r.get("callee"), r.get("args"), k + 1))
        params.append(("f", f"fn{n}", ["params_x", "v0"]))
        want |= {("f", f"fn{n}", *x) for x in _by_paths(rows, ["params_x", "v0"])}
    assert len(want) > 20
    il = spark.createDataFrame(il, "file string, fn string, ord long, kind string, lhs string, callee string, args array<string>, line int")
    params = spark.createDataFrame(params, "file string, fn string, params array<string>")
    rules = [{"rule": "CommandInjection", "pattern": "system", "match": "exact", "arg": None, "sanitizers": []}]
    got = cfg.cfg_findings(il, rules, ("params",), ("clean",), params)
    assert {tuple(r) for r in got.collect()} == want
    skipped = cfg.cfg_findings(il, rules, ("params",), ("clean",), params, limit=2).where("status = 'skipped'")
    assert skipped.count() > 0
    assert cfg.cfg_findings(il.limit(0), rules, ("params",), ("clean",), params).count() == 0


def test_language_rules(spark):
    from sparkhound.sources.default_rules import default_rules_text, default_sinks
    from sparkhound.sources.rules import parse_rules

    rows = parse_rules(default_rules_text("elixir", "javascript", "nim", "ocaml", "rust"))
    blocks = {(r["rule"], tuple(r["langs_in"])) for r in rows}
    assert len(blocks) == 42 and ("CommandInjection", ("javascript", "typescript")) in blocks and ("SilentErrorSwallow", ("ocaml",)) in blocks
    calls = [("HTTPoison.get", "elixir"), ("HTTPoison.get", "ruby"), ("fs.readFile", "typescript"), ("osproc.execProcess", "nim"), ("reqwest::get", "rust"), ("Marshal.from_string", "ocaml"), ("try", "ocaml"), ("retry", "ocaml")]
    nodes = _nodes(spark, [("a", 1, "def", "f", [("var", "params")], {})] + [("a", k + 2, "call", name, [("var", "params")], {}) for k, (name, _) in enumerate(calls)])
    nodes = nodes.withColumn("language", F.element_at(F.array(F.lit("x"), *[F.lit(x) for _, x in calls]), F.col("line")))
    got = {(r["line"], r["rule"]) for r in matching.findings(nodes, default_sinks(spark), taint.analyse(nodes)).collect()}
    assert {(2, "Elixir-SSRF"), (4, "PathTraversal"), (5, "NimCommandInjection"), (6, "RustSSRF"), (7, "OCamlMarshalDeserialization"), (7, "OCamlUnsafeOperations"), (8, "SilentErrorSwallow")} <= got
    assert (3, "Elixir-SSRF") not in got and (9, "SilentErrorSwallow") not in got


def test_sanitised_calls_of_each_language_are_silent(spark):
    from sparkhound.sources.default_rules import default_rules_text, default_sinks, default_sources
    from sparkhound.sources.rules import parse_rules

    cases = [
        ("elixir", "HTTPoison.get", "safe_url?", "Elixir-SSRF"), ("elixir", "Repo.query", "fragment", "Elixir-SQL-Injection"), ("javascript", "cp.execSync", "sanitize", "CommandInjection"), ("typescript", "fs.open", "path.resolve", "PathTraversal"),
        ("nim", "execCmd", "quoteShell", "NimCommandInjection"), ("nim", "db_mysql.getValue", "db_mysql.escape", "NimSQLInjection"), ("ocaml", "Sys.command", "Filename.quote", "OCamlCommandInjection"), ("rust", "reqwest::get", "Url::parse", "RustSSRF"),
        ("gleam", "simplifile.read", "validate_path", "PathTraversal"), ("gleam", "os.cmd", "escape", "CommandInjection"), ("gleam", "http.get", "URI.encode", "SSRF"), ("gleam", "YAML.parse", "load_config", None),
    ]
    rows = [("a", 1, "def", "f", [("var", "params")], {})]
    for k, (_, sink, clean, _) in enumerate(cases):
        rows += [("a", 2 * k + 2, "call", sink, [("var", "params")], {}), ("a", 2 * k + 3, "call", sink, [("call", clean), ("var", "params")], {})]
    nodes = _nodes(spark, rows)
    nodes = nodes.withColumn("language", F.element_at(F.array(F.lit("x"), *[F.lit(c[0]) for c in cases for _ in (0, 1)]), F.col("line")))
    found = {(r["line"], r["rule"]) for r in matching.findings(nodes, default_sinks(spark), taint.analyse(nodes)).collect()}
    for k, (_, _, _, rule) in enumerate(cases):
        if rule:
            assert (2 * k + 2, rule) in found and (2 * k + 3, rule) not in found, cases[k]
    assert not {x for x in found if x[0] in (24, 25)}  # decoders of a language that the rule leaves out
    everything = parse_rules(default_rules_text())
    assert len({r["rule"] for r in everything}) == 53 and sum(len(r["sanitizers"]) for r in everything) > 400 and {r["match"] for r in everything} == {"substring", "exact"}
    assert {"conn.params", "STDIN", "std::env::args", "callbackUrl"} <= set(default_sources())


def test_xml_trees(spark):
    import xml.etree.ElementTree as E

    from sparkhound.sources.xml_trees import xml_trees

    text = '<source_file srow="0" scol="0" erow="9" ecol="1"><def field="name" srow="1" scol="2" erow="3" ecol="4">a &lt; b<x/>tail</def><def>é😀<y><z/></y></def></source_file>'
    docs = spark.createDataFrame([("a", text), ("b", "<r><broken></r>"), ("c", None), ("d", ""), ("e", '<!DOCTYPE r [<!ENTITY x "y">]><r>&x;</r>')], "file string, content string")
    got = {}
    for r in xml_trees(docs).orderBy("file", "node_id").collect():
        got.setdefault(r["file"], []).append(r)
    want, todo = [], [(E.fromstring(text), None, 0, 0)]
    while todo:
        node, parent, ix, depth = todo.pop()
        want.append((len(want), parent, ix, depth, node.tag, (node.text or "").strip() + "".join((c.tail or "").strip() for c in node)))
        todo += [(c, want[-1][0], k, depth + 1) for k, c in reversed(list(enumerate(node)))]
    assert [(r["node_id"], r["parent_id"], r["child_ix"], r["depth"], r["tag"], r["text"]) for r in got["a"]] == want
    assert [r["subtree_end"] for r in got["a"]] == [5, 2, 2, 5, 5, 5] and (got["a"][1]["line"], got["a"][1]["column"], got["a"][1]["field"]) == (2, 3, "name")
    assert [r["tag"] for r in got["b"]] == ["r", "broken"] and "mismatched" in got["b"][0]["error"]
    assert got["c"][0]["tag"] is None and got["c"][0]["error"] and len(got["d"]) == 1
    assert got["e"][0]["text"] in ("", "y")


def test_supply_chain_reports(spark):
    import json

    from sparkhound.plans import reports

    audited = spark.createDataFrame([("a", "1", 2, "critical"), ("b", None, 0, "clean"), ("c", "3", 1, "warning")], "name string, version string, n_vulns long, level string")
    known = spark.createDataFrame([("a", "X-2", "bad", "HIGH", False), ("a", "X-1", "worse", "CRITICAL", False), ("c", None, None, "", True)], "name string, id string, summary string, severity string, failed boolean")
    out = json.loads(reports.supply_chain(audited, known))
    assert out["summary"] == {"critical": 1, "warning": 1, "clean": 1} and [d["name"] for d in out["dependencies"]] == ["a", "c", "b"]
    assert [a["id"] for a in out["dependencies"][0]["advisories"]] == ["X-1", "X-2"] and out["dependencies"][1]["advisories"] == []
    from sparkhound.schema import FINDINGS

    reach_ = ("Live", "http", "index", 2, [("a.cr", 3), ("b.cr", 9)])
    found = spark.createDataFrame([("SSRF", "High", "b.cr", 9, "m", [], "crystal", None, reach_, None)], FINDINGS)
    run = json.loads(reports.sarif(found, audited=audited))["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["SSRF", "dependency", "dependency"] and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["SSRF", "dependency"]
    assert run["results"][0]["properties"]["reachability"]["path"] == ["a.cr:3", "b.cr:9"] and run["results"][1]["level"] == "error"


def test_all_smells_are_the_union_of_the_detectors(spark):
    """Scopes worked out once give what each detector finds by itself, one row for each rule, file and line."""
    from sparkhound.program_queries import program

    nodes = program(spark, "/root/testdata/sf0.001").cache()
    classes = smells.class_table(nodes).cache()
    by_nodes = [smells.high_complexity, smells.long_method, smells.spaghetti, smells.long_parameter_list, smells.deep_nesting, smells.god_object, smells.complex_conditional, smells.message_chain, smells.flag_argument, smells.complex_match, smells.dead_code, smells.shotgun_surgery, smells.hub_like_module, smells.feature_envy, smells.data_clumps, smells.dry_violation, smells.orphaned_spawn, smells.muted_pack, smells.dead_letter, smells.anti_singleton]
    by_classes = [smells.lazy_class, smells.large_class, smells.blob, smells.base_class_should_be_abstract, smells.speculative_generality, smells.deep_inheritance, smells.tradition_breaker, smells.parallel_inheritance]
    found = [f(nodes) for f in by_nodes] + [f(classes) for f in by_classes] + [smells.refused_bequest(classes, nodes), smells.knows_derived(classes, nodes), smells.data_class(nodes, classes)]
    want = {}
    for df in found:
        for r in df.collect():
            key = (r["rule"], r["file"], r["line"])
            want[key] = min(want.get(key, (r["subject"], r["severity"], r["value"])), (r["subject"], r["severity"], r["value"]))
    got = smells.all_smells(nodes).collect()
    assert len(got) == len(want) and {(r["rule"], r["file"], r["line"]): (r["subject"], r["severity"], r["value"]) for r in got} == want
    assert len({k[0] for k in want}) >= 15
