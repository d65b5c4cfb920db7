"""Expression trees as rows: reader, projection to nodes, tree smells and lint templates.

A tree row has its pre-order number and the number of its subtree's last row. What is open around a row is counted by windows
(intervals); most other detectors are an aggregate or a parent-child equi-join. No row is compared with all others of its function.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..schema import ARG, EXPRS
from ..plans.fixpoint import large
from .intervals import with_level, within

_COLUMNS = [c.split()[0] for c in EXPRS.split(", ")]
_BY = ["file", "fn_id"]


def flatten(file: str, fn: str, tree: dict) -> list[tuple]:
    """Rows of a nested tree {kind, name, literal_kind, literal, op, line, children}; any depth, no recursion."""
    rows: list[list] = []
    stack = [(tree, None, 0, 0)]
    while stack:
        t, parent, ix, depth = stack.pop()
        k = len(rows)
        rows.append([file, fn, k, parent, ix, t.get("kind", "unknown"), t.get("name") or "", t.get("literal_kind"), t.get("literal"), t.get("op"), t.get("line") or 0, depth, k, k])
        stack += [(c, k, j, depth + 1) for j, c in reversed(list(enumerate(t.get("children") or [])))]
    for r in reversed(rows):  # children come after their parents
        if r[3] is not None:
            rows[r[3]][13] = max(rows[r[3]][13], r[13])
    return [tuple(r) for r in rows]


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Expression rows from JSON lines {file, fn, tree}, as parsers write them; a broken line gives no rows."""

    def run(batches):
        for b in batches:
            rows = []
            for line in b.column(0).to_pylist():
                try:
                    t = json.loads(line)
                    rows += flatten(t["file"], t["fn"], t["tree"])
                except (ValueError, KeyError, TypeError):
                    continue
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _COLUMNS)

    return spark.read.text(path).mapInArrow(run, EXPRS)


def children(exprs: DataFrame) -> DataFrame:
    """(file, fn_id, parent_id, kids): each row's children in order, as structs."""
    kid = F.struct("child_ix", "expr_id", "kind", "name", "literal_kind", "literal", "op", "pre_order", "subtree_end")
    return exprs.where("parent_id IS NOT NULL").groupBy(*_BY, "parent_id").agg(F.sort_array(F.collect_list(kid)).alias("kids"))


def with_kids(exprs: DataFrame) -> DataFrame:
    c = children(exprs).withColumnRenamed("parent_id", "expr_id")
    empty = F.array().cast(c.schema["kids"].dataType)
    return exprs.join(large(c), [*_BY, "expr_id"], "left").withColumn("kids", F.coalesce("kids", empty))


def subtree_vars(exprs: DataFrame) -> DataFrame:
    """(file, fn_id, expr_id, vars): variables inside composite expressions, sixteen levels deep at most (P-02)."""
    composite = F.col("kind").isin("binary", "unary")
    inside = within(exprs, _BY, composite, F.col("kind") == "var", [F.col("expr_id"), F.col("depth")]).where("depth <= outer.depth + 16")
    return inside.groupBy(*_BY, F.col("outer.expr_id").alias("expr_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pre_order", "name"))), lambda x: x["name"]).alias("vars"))


def to_nodes(exprs: DataFrame, language: str = "") -> DataFrame:
    """Program facts of the trees (P-01): functions, imports, types, assignments, calls, controls, terminators and tries."""
    rows = with_kids(exprs).join(subtree_vars(exprs), [*_BY, "expr_id"], "left")
    inner = subtree_vars(exprs).withColumnsRenamed({"expr_id": "k_id", "vars": "k_vars"})
    one = lambda kind, value: F.struct(kind.alias("arg_type"), value.alias("value"), F.lit("").alias("field"))
    kid = lambda k: one(
        F.when(k["kind"] == "var", "var").when(k["kind"] == "literal", "literal").when(k["kind"] == "app", "call").otherwise("unknown"),
        F.when(k["kind"] == "literal", F.coalesce(k["literal"], F.lit(""))).otherwise(k["name"]),
    )
    kind = (
        F.when(F.col("kind") == "function", "def").when(F.col("kind") == "import", "import").when(F.col("kind").isin("class", "module", "enum"), F.col("kind"))
        .when(F.col("kind").isin("let", "assign"), "assign").when(F.col("kind").isin("app", "field", "try"), "call").when(F.col("kind").isin("if", "case"), "control")
        .when(F.col("kind").isin("error", "return", "raise"), "terminator")
    )
    has_else = F.size("kids") > 2
    name = (
        F.when(F.col("kind") == "if", F.when(has_else, "if_else").otherwise("if")).when(F.col("kind") == "case", "case").when(F.col("kind") == "try", "try")
        .when(F.col("kind") == "import", "require").otherwise(F.col("name"))
    )
    params = F.transform(F.filter("kids", lambda k: k["kind"] == "param"), lambda k: one(F.lit("var"), k["name"]))
    args = (
        F.when(F.col("kind") == "function", params)
        .when(F.col("kind") == "case", F.array(one(F.lit("literal"), F.size("kids").cast("string"))))
        .when(F.col("kind") == "import", F.array(one(F.lit("literal"), F.col("name"))))
        .when(F.col("kind").isin("app", "let", "assign"), F.transform(F.filter("kids", lambda k: k["child_ix"] >= 0), kid))
        .otherwise(F.array().cast(f"array<{ARG}>"))
    )
    out = rows.withColumns({"node_type": kind, "n": name, "args": args}).where("node_type IS NOT NULL")
    # a composite argument stands as <expr:a;b> and once more for each of its variables
    comp = out.where("kind IN ('app', 'let', 'assign')").select(*_BY, "expr_id", F.explode("kids").alias("k")).where("k.kind IN ('binary', 'unary')").select(*_BY, "expr_id", F.col("k.expr_id").alias("k_id"))
    comp = comp.join(inner, [*_BY, "k_id"]).groupBy(*_BY, "expr_id").agg(F.sort_array(F.collect_list(F.struct("k_id", "k_vars"))).alias("comp"))
    extra = F.flatten(F.transform("comp", lambda c: F.concat(F.array(one(F.lit("unknown"), F.concat(F.lit("<expr:"), F.array_join(c["k_vars"], ";"), F.lit(">")))), F.transform(c["k_vars"], lambda v: one(F.lit("var"), v)))))
    out = out.join(comp, [*_BY, "expr_id"], "left").withColumn("args", F.when(F.col("comp").isNotNull(), F.concat(F.filter("args", lambda a: (a["arg_type"] != "unknown") | (a["value"] != "")), extra)).otherwise(F.col("args")))
    order = Window.partitionBy("file").orderBy("line", "fn_id", "pre_order")
    return out.select(
        "file", F.row_number().over(order).cast("bigint").alias("ord"), "line", "node_type", F.col("n").alias("name"), "args", F.lit(False).alias("taint"), F.lit(language).alias("language"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


# -- lint templates: each gives (rule, severity, file, fn_id, line, subject)


def _hit(df: DataFrame, rule: Column | str, severity: Column | str, subject: Column | str = "name") -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(as_col(rule).alias("rule"), as_col(severity).alias("severity"), "file", "fn_id", "line", (F.col(subject) if isinstance(subject, str) else subject).alias("subject"))


def name_lookup(exprs: DataFrame, names: DataFrame) -> DataFrame:
    """A1: called names in names(rule, severity, name, hint); a table that people write, so it is broadcast."""
    calls = exprs.where("kind IN ('app', 'field')")
    return _hit(calls.join(F.broadcast(names), "name"), F.col("rule"), F.col("severity"))


def shape(exprs: DataFrame, parent: Column, child: Column, rule: str, severity: str) -> DataFrame:
    """A2: rows that meet ``parent`` with a child that meets ``child``; the child's columns are called c_*."""
    kid = exprs.select(*_BY, F.col("parent_id").alias("expr_id"), *[F.col(c).alias(f"c_{c}") for c in ("kind", "name", "op", "literal", "literal_kind", "child_ix")])
    return _hit(exprs.where(parent).join(large(kid.where(child)), [*_BY, "expr_id"]).dropDuplicates([*_BY, "expr_id"]), rule, severity)


def count_over(exprs: DataFrame, which: Column, least: int, rule: str, severity: str) -> DataFrame:
    """A3: functions with at least ``least`` rows of a kind."""
    n = exprs.where(which).groupBy(*_BY).agg(F.count("*").alias("n"), F.min("line").alias("line")).where(F.col("n") >= least)
    return _hit(n, rule, severity, F.col("n").cast("string"))


def literal_match(exprs: DataFrame, test: Column, rule: str, severity: str) -> DataFrame:
    """A4: literals that meet a test."""
    return _hit(exprs.where("kind = 'literal'").where(test), rule, severity, "literal")


def followed_by(exprs: DataFrame, first: Column, then: Column, rule: str, severity: str, adjacent: bool = False) -> DataFrame:
    """A5: a row meeting ``then`` after one meeting ``first`` in the same function; ``adjacent``: among the called rows, the next."""
    calls = exprs.where("kind IN ('app', 'return', 'raise', 'assign')")
    w = Window.partitionBy(*_BY).orderBy("pre_order")
    seen = F.lag(first).over(w) if adjacent else F.max(first).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return _hit(calls.withColumn("seen", seen).where(F.col("seen") & then), rule, severity)


def nested_deeper(exprs: DataFrame, which: Column, least: int, rule: str, severity: str) -> DataFrame:
    """A6: chains of at least ``least`` rows of a kind, each directly inside another such row."""
    deep = with_level(exprs.where(which), _BY, F.lit(True), "n").withColumn("n", F.col("n_level") + 1).where(F.col("n") >= least)
    return _hit(deep, rule, severity, F.col("n").cast("string"))


def unused_bindings(exprs: DataFrame, rule: str = "unused-binding", severity: str = "Hint") -> DataFrame:
    """A7: bound names that nothing later in the function reads; names that begin with _ are meant to be unused."""
    bound = exprs.where("kind IN ('let', 'param') AND name NOT LIKE '\\_%'")
    last = exprs.where("kind IN ('var', 'app', 'field')").groupBy(*_BY, P.first_segment(F.col("name")).alias("name")).agg(F.max("pre_order").alias("at"))
    return _hit(bound.join(large(last), [*_BY, "name"], "left").where("at IS NULL OR at <= pre_order"), rule, severity)


def shadowed(exprs: DataFrame, rule: str = "shadow-variable", severity: str = "Hint") -> DataFrame:
    """A7: names bound a second time in a function."""
    w = Window.partitionBy(*_BY, "name").orderBy("pre_order")
    return _hit(exprs.where("kind IN ('let', 'param') AND name <> '_'").withColumn("r", F.row_number().over(w)).where("r > 1"), rule, severity)


# -- tree smells


def complexity(exprs: DataFrame, limits: tuple[int, int] = (10, 20)) -> DataFrame:
    """One more than the decisions; an if with else counts two, a case its branches; conditions are not looked into."""
    rows = with_kids(exprs)
    asked = rows.where("kind IN ('if', 'case') AND size(kids) > 0").select(*_BY, F.col("kids")[0]["expr_id"].alias("expr_id"), F.lit(True).alias("asked"))
    score = F.when(F.col("kind") == "if", F.when(F.size("kids") > 2, 2).otherwise(1)).when(F.col("kind") == "case", F.greatest(F.size("kids") - 1, F.lit(0))).when((F.col("kind") == "binary") & F.col("op").isin("&&", "||"), 1)
    marked = rows.withColumn("score", score).join(asked, [*_BY, "expr_id"], "left")
    free = with_level(marked, _BY, F.col("asked"), "c").where("score IS NOT NULL AND asked IS NULL AND c_level = 0")
    n = free.groupBy(*_BY).agg((F.sum("score") + 1).alias("n"), F.min("line").alias("line"))
    sev = F.when(F.col("n") >= limits[1], "High").when(F.col("n") >= limits[0], "Medium")
    return _hit(n.withColumn("s", sev).where("s IS NOT NULL"), "HighComplexity", F.col("s"), F.col("n").cast("string"))


def magic_numbers(exprs: DataFrame) -> DataFrame:
    """Numbers other than the usual ones, constants' own values aside."""
    plain = F.regexp_replace("literal", r"_|(?:[iuf](?:8|16|32|64))$", "")
    usual = plain.isin("0", "1", "2", "-1", "10", "100", "1000", "0.0", "1.0")
    named = exprs.where("kind IN ('let', 'assign') AND name RLIKE '^[A-Z][A-Z0-9_]*$'").select(*_BY, F.col("expr_id").alias("parent_id"))
    return _hit(exprs.where("kind = 'literal' AND literal_kind IN ('int', 'float')").where(~usual).join(named, [*_BY, "parent_id"], "left_anti"), "MagicNumber", "Low", "literal")


def empty_catch(exprs: DataFrame) -> DataFrame:
    return _hit(with_kids(exprs).where("kind = 'rescue' AND size(kids) = 0"), "EmptyCatch", "Medium")


def return_from_finally(exprs: DataFrame) -> DataFrame:
    return _hit(with_level(exprs.where("kind IN ('return', 'ensure')"), _BY, F.col("kind") == "ensure", "e").where("kind = 'return' AND e_level > 0"), "ReturnFromFinally", "High")


def float_equality(exprs: DataFrame) -> DataFrame:
    return shape(exprs, F.col("kind").isin("binary") & F.col("op").isin("==", "!="), (F.col("c_kind") == "literal") & (F.col("c_literal_kind") == "float"), "FloatEquality", "Medium")


def duplicate_trees(exprs: DataFrame, length: int = 40, depth: int = 4, least: int = 4) -> DataFrame:
    """(hash, n, files, file, line): subtrees equal up to variable names, long enough and not too deep, at four places in two files (P-12)."""
    text = F.concat_ws(":", "kind", F.when(F.col("kind").isin("var", "param", "let", "assign"), "_").otherwise(F.col("name")), F.coalesce("op", F.lit("")), F.coalesce("literal", F.lit("")))
    rows = exprs.select(*_BY, "expr_id", "line", "depth", "pre_order", "subtree_end", text.alias("t"))
    top = F.col("subtree_end") > F.col("pre_order")
    at = [F.col(c) for c in ("expr_id", "line", "depth")]
    # a row is in its own tree and in those of the nearest rows around it, as many as the depth allows
    part = within(rows, _BY, top, F.lit(True), at, depth).unionByName(rows.where(top).withColumn("outer", F.struct(*at)))
    part = part.select(*_BY, "outer.expr_id", "outer.line", F.struct(F.col("pre_order").alias("p"), (F.col("depth") - F.col("outer.depth")).alias("l"), F.col("t").alias("x")).alias("s"))
    form = part.where(f"s.l <= {depth}").groupBy(*_BY, "expr_id", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.concat_ws("/", s["l"], s["x"])), " ").alias("form"))
    n = form.where(F.length("form") >= length).groupBy(F.md5("form").alias("hash")).agg(F.count_distinct("file", "line").alias("n"), F.count_distinct("file").alias("files"), F.min(F.struct("file", "line")).alias("at"))
    return n.where(f"n >= {least} AND files >= 2").select("hash", "n", "files", "at.file", "at.line")


def intimacy(exprs: DataFrame, most: int = 3) -> DataFrame:
    """Functions that read more than three fields of one other object."""
    acc = exprs.where("kind = 'field' AND name LIKE '%.%' AND name NOT LIKE 'self.%'").groupBy(*_BY, P.first_segment(F.col("name")).alias("other")).agg(F.count_distinct("name").alias("n"), F.min("line").alias("line"))
    return _hit(acc.where(F.col("n") > most), "InappropriateIntimacy", "Low", "other")


def lint(exprs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """All tree rules that need no dictionary, and name lookup where one is given."""
    app = F.col("kind") == "app"
    found = [
        unused_bindings(exprs), shadowed(exprs), complexity(exprs), magic_numbers(exprs), empty_catch(exprs), return_from_finally(exprs), float_equality(exprs), intimacy(exprs),
        literal_match(exprs, P.secret_literal(F.col("literal")), "hardcoded-secrets", "Error"), literal_match(exprs, P.address_literal(F.col("literal")), "hardcoded-urls", "Warning"),
        literal_match(exprs, F.col("literal").rlike(r"(?i)\b(?:todo|fixme)\b"), "todo-in-code", "Warning"), nested_deeper(exprs, F.col("kind") == "case", 2, "nested-case", "Warning"),
        nested_deeper(exprs, F.col("kind") == "ternary", 2, "nested-ternary", "Warning"), nested_deeper(exprs, F.col("kind") == "lambda", 3, "callback-hell", "Warning"),
        nested_deeper(exprs, F.col("kind") == "function", 2, "nested-function", "Hint"), count_over(exprs, F.col("kind") == "param", 6, "too-many-params", "Hint"),
        count_over(exprs, F.col("kind") == "pipe", 6, "pipeline-steps-overload", "Hint"), count_over(exprs, app & F.col("name").rlike("(?:^|\\.)(?:is_a|nil)\\?$"), 3, "type-checker-abuse", "Hint"),
        shape(exprs, F.col("kind").isin("if", "while"), F.col("c_kind").isin("assign") & (F.col("c_child_ix") == 0), "assignment-in-condition", "Warning"),
        shape(exprs, (F.col("kind") == "binary") & (F.col("op") == "=="), (F.col("c_kind") == "literal") & F.col("c_literal").isin("true", "false"), "equals-true", "Hint"),
        followed_by(exprs, F.col("name").rlike(r"\.exists?\??$"), F.col("name").rlike(r"\.(?:read|open|delete|write)$"), "toctou-pattern", "Warning", adjacent=True),
        followed_by(exprs, F.col("kind").isin("return", "raise"), app, "unreachable-code", "Warning", adjacent=True),
    ]
    if names is not None:
        found.append(name_lookup(exprs, names))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["rule", "file", "fn_id", "line", "subject"])
