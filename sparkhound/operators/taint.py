"""Taint: seeds, propagation to a fixpoint, returns, guards.

Cleansing is stratified: assignments that sanitise are taken out of the flow first, so what remains is monotone and set
semantics hold. Records are (file, var, field).
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import words as W
from ..functions.words import SANITIZERS, SOURCES
from ..plans.fixpoint import durable, fixpoint
from ..plans.fixpoint import large as merged
from ..schema import STEP
from .scopes import last_call_on_line, with_scope

KEYS = ["file", "var", "field"]
#: Edges of a file up to which one task goes through it.
LARGE = 1_000_000
#: Facts up to which the files of a round are broadcast.
FEW = 100_000
#: Facts that are sent on together, about.
ROWS = 8192


def _arg_values(kind: str):
    return F.transform(F.filter("args", lambda a: a["arg_type"] == kind), lambda a: a["value"])


def sanitising(nodes: DataFrame, sanitizers: list[str] = SANITIZERS) -> DataFrame:
    """Assignments of a sanitiser call's result; they give clean values."""
    return nodes.where("node_type = 'assign'").where(F.exists("args", lambda a: (a["arg_type"] == "call") & P.any_substring(a["value"], sanitizers)))


def seeds(nodes: DataFrame, sources: list[str] = SOURCES, sanitizers: list[str] = SANITIZERS) -> DataFrame:
    """(file, var, field, source): first facts, by parameter, source call, extractor flag, module attribute and scent (G-01..G-05)."""
    assigns = nodes.where("node_type = 'assign'")
    clean = F.exists("args", lambda a: (a["arg_type"] == "call") & P.any_substring(a["value"], sanitizers))
    params = nodes.where("node_type = 'def'").select("file", F.explode("args").alias("a")).where(P.any_prefix(F.col("a.value"), sources)).select("file", F.col("a.value").alias("var"), F.lit("parameter").alias("source"), F.lit(1).alias("o"))
    from_call = assigns.where(F.exists("args", lambda a: (a["arg_type"] == "call") & P.any_prefix(a["value"], sources)) & ~clean).select("file", F.col("name").alias("var"), F.lit("source").alias("source"), F.lit(2).alias("o"))
    flagged = assigns.where(F.col("taint") & ~clean).select("file", F.col("name").alias("var"), F.lit("extractor").alias("source"), F.lit(3).alias("o"))
    attributes = assigns.where(F.col("file").rlike(r"\.exs?$") & F.col("name").startswith("@")).select("file", F.col("name").alias("var"), F.lit("attribute").alias("source"), F.lit(4).alias("o"))
    scent = assigns.where((F.col("metadata")["scent"] == "true") & ~F.col("taint")).select("file", F.col("name").alias("var"), F.lit("scent").alias("source"), F.lit(5).alias("o"))
    found = params.unionByName(from_call).unionByName(flagged).unionByName(attributes).unionByName(scent)
    return found.groupBy("file", "var").agg(F.min_by("source", "o").alias("source")).select("file", "var", F.lit("").alias("field"), "source")


def flows(nodes: DataFrame, sanitizers: list[str] = SANITIZERS) -> DataFrame:
    """(file, src, src_field, dst, dst_field): one-step value flow inside files (G-07, G-09..G-11).

    A string method passes on its receiver's taint, and only that.
    """
    assigns = nodes.where("node_type = 'assign'")
    clean = sanitising(nodes, sanitizers).select("file", F.col("name").alias("dst")).distinct()
    vars_ = assigns.select("file", F.col("name").alias("dst"), F.explode(F.array_distinct(_arg_values("var"))).alias("src"))
    calls = last_call_on_line(nodes).where(~P.any_substring(F.col("call.name"), sanitizers))
    through = assigns.join(merged(calls), ["file", "line"]).select("file", F.col("name").alias("dst"), F.explode(F.transform(F.filter("call.args", lambda a: a["arg_type"] == "var"), lambda a: a["value"])).alias("src"))
    method = assigns.select("file", F.col("name").alias("dst"), F.explode(_arg_values("call")).alias("c")).where(P.is_string_method(F.col("c")) & F.contains("c", F.lit(".")))
    receivers = method.select("file", "dst", F.expr("left(c, length(c) - length(substring_index(c, '.', -1)) - 1)").alias("src"))
    plain = through.unionByName(receivers).select("file", "src", F.lit("").alias("src_field"), "dst", F.lit("").alias("dst_field"))
    parsed = assigns.where(F.exists("args", lambda a: (a["arg_type"] == "call") & a["value"].isin(*W.URI_CONSTRUCTORS)))
    uri = parsed.select("file", F.col("name").alias("dst"), F.explode(_arg_values("var")).alias("src")).select(
        "file", "src", F.lit("").alias("src_field"), "dst", F.explode(F.array(*map(F.lit, W.URI_FIELDS))).alias("dst_field")
    )
    # an assignment x = y hands on y and all of its fields alike: no field on either side
    alias = vars_.select("file", "src", F.lit(None).cast("string").alias("src_field"), "dst", F.lit(None).cast("string").alias("dst_field"))
    return plain.unionByName(uri).unionByName(alias).join(merged(clean), ["file", "dst"], "left_anti").distinct()


def propagate(seed: DataFrame, edges: DataFrame, large: int = LARGE) -> DataFrame:
    """All tainted (file, var, field, source): the closure of the seeds over the edges (G-13); an edge without a field passes on any.

    Value flows inside files only, so each file is gone through once, by itself, in the task that holds it. Files of more than ``large`` edges
    are joined round by round instead. Of several sources of a fact one stays.
    """
    many = edges.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > large).select("file")
    if many.isEmpty():
        return _by_file(seed, edges)
    many = F.broadcast(durable(many))
    few = _by_file(seed.join(many, "file", "left_anti"), edges.join(many, "file", "left_anti"))
    own = durable(edges.join(many, "file", "left_semi"))

    def step(delta: DataFrame) -> DataFrame:
        out = delta.withColumnRenamed("var", "src").join(merged(own), ["file", "src"]).where("src_field IS NULL OR src_field = field")
        return out.select("file", F.col("dst").alias("var"), F.coalesce("dst_field", "field").alias("field"), "source")

    return few.unionByName(fixpoint(seed.select(*KEYS, "source").join(many, "file", "left_semi"), step, KEYS))


def _by_file(seed: DataFrame, edges: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    facts = seed.select("file", F.col("var").alias("a"), F.col("field").alias("b"), F.col("source").alias("c"), none.alias("d"), F.lit(True).alias("seed"))
    flow = edges.select("file", F.col("src").alias("a"), F.col("src_field").alias("b"), F.col("dst").alias("c"), F.col("dst_field").alias("d"), F.lit(False).alias("seed"))
    rows = facts.unionByName(flow).repartition("file").sortWithinPartitions("file", "seed", "a", "b", "c", "d")
    return rows.mapInArrow(_closures, "file string, var string, field string, source string")


def _closure(seeds: list[tuple], edges: dict[str, list[tuple]]) -> dict[tuple, str]:
    """Source of each reached (var, field), breadth first."""
    known = {}
    for var, field, source in seeds:
        known.setdefault((var, field), source)
    todo = deque(known)
    while todo:
        var, field = todo.popleft()
        for src_field, dst, dst_field in edges.get(var, ()):
            if src_field is None or src_field == field:
                new = (dst, field if dst_field is None else dst_field)
                if new not in known:
                    known[new] = known[var, field]
                    todo.append(new)
    return known


def _closures(batches):
    """Closures of one file after the other; a file's edges come before its seeds. Facts of many files are sent on together."""
    file, edges, seeds = None, {}, []
    out: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["file", "var", "field", "source"])

    for b in batches:
        for at, x, y, z, d, seed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != file:
                if seeds:
                    out += [(file, *fact, source) for fact, source in _closure(seeds, edges).items()]
                    if len(out) >= ROWS:
                        yield batch()
                        out = []
                file, edges, seeds = at, {}, []
            if seed:
                seeds.append((x, y, z))
            else:
                edges.setdefault(x, []).append((y, z, d))
    if seeds:
        out += [(file, *fact, source) for fact, source in _closure(seeds, edges).items()]
    if out:
        yield batch()


def _assignments_inside(nodes: DataFrame) -> DataFrame:
    """(file, name, taint, func_name) of assignments inside functions."""
    return with_scope(nodes).where("node_type = 'assign' and scope_line is not null").select("file", "name", "taint", F.col("scope_name").alias("func_name"))


def tainted_returns(nodes: DataFrame, taint: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """(file, func_name): functions in whose body a tainted or flagged assignment stands (G-14)."""
    inside = _assignments_inside(nodes) if inside is None else inside
    known = taint.where("field = ''").select("file", F.col("var").alias("name"), F.lit(True).alias("hit")).distinct()
    return inside.join(merged(known), ["file", "name"], "left").where("hit or taint").select("file", "func_name").distinct()


def from_returns(nodes: DataFrame, returns: DataFrame, imports: DataFrame | None = None, sanitizers: list[str] = SANITIZERS) -> DataFrame:
    """Assignments from calls of tainted functions of the same file or, where imports(file, imported_file) say so, of another (G-15, G-16)."""
    calls = nodes.where("node_type = 'assign'").select("file", F.col("name").alias("var"), F.explode(_arg_values("call")).alias("callee")).where(~P.any_substring(F.col("callee"), sanitizers))
    calls = calls.withColumn("func_name", P.last_segment(F.col("callee")))
    local = calls.join(merged(returns), ["file", "func_name"]).select("file", "var")
    if imports is not None:
        there = returns.withColumnRenamed("file", "imported_file")
        local = local.unionByName(calls.join(merged(imports), "file").join(merged(there), ["imported_file", "func_name"]).select("file", "var"))
    return local.distinct().select("file", "var", F.lit("").alias("field"), F.lit("return").alias("source"))


def same_names(taint: DataFrame, edges: DataFrame) -> DataFrame:
    """Variables that another file taints under the same name, where a file passes them on (J-14, G-12).

    Names are few against their uses, so they are made distinct before they meet the files.
    """
    names = taint.where("field = ''").select(F.col("var").alias("src")).distinct()
    return edges.select("file", "src").distinct().join(names, "src").select("file", F.col("src").alias("var"), F.lit("").alias("field"), F.lit("name").alias("source"))


def analyse(nodes: DataFrame, imports: DataFrame | None = None, sources: list[str] = SOURCES, sanitizers: list[str] = SANITIZERS, by_name: bool = False) -> DataFrame:
    """The whole pipeline: seed, propagate, returns, interprocedural, propagate again (G-17).

    ``by_name``: a tainted variable taints those of its name in all files. It is off, as files that have nothing to do with each other share names.
    """
    edges, inside = durable(flows(nodes, sanitizers)), durable(_assignments_inside(nodes))
    taint = delta = durable(propagate(seeds(nodes, sources, sanitizers), edges))
    while True:
        # only what the last round found makes returns, and only files that learn of them are gone through again
        more = from_returns(nodes, tainted_returns(nodes, delta, inside), imports, sanitizers)
        more = more.unionByName(same_names(delta, edges)) if by_name else more
        more = durable(more.join(merged(taint.select(KEYS)), KEYS, "left_anti"))
        n = more.count()
        if n == 0:
            return taint
        files = more.select("file").distinct()
        own = edges.join(F.broadcast(files) if n <= FEW else merged(files), "file", "left_semi")
        delta = durable(propagate(more, own).join(merged(taint.select(KEYS)), KEYS, "left_anti"))
        taint = taint.unionByName(delta)


def guard_lines(nodes: DataFrame) -> DataFrame:
    """(file, var, guard_line): the first line from which a variable is guarded (G-18)."""
    return nodes.where("node_type = 'guard'").select("file", "line", F.explode(_arg_values("var")).alias("var")).groupBy("file", "var").agg(F.min("line").alias("guard_line"))


def sink_hits(calls: DataFrame, taint: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """(file, line, name, var, position): calls with a tainted variable argument that no guard above the line clears."""
    used = calls.select("file", "ord", "line", "name", F.posexplode("args").alias("position", "a")).where("a.arg_type = 'var'")
    hit = used.select("file", "ord", "line", "name", "position", F.col("a.value").alias("var"), P.first_segment(F.col("a.value")).alias("root"))
    known = taint.where("field = ''").select("file", F.col("var").alias("root")).distinct()
    out = hit.join(merged(known), ["file", "root"])
    if guards is not None:
        out = out.join(merged(guards.withColumnRenamed("var", "root")), ["file", "root"], "left").where("guard_line is null or line < guard_line").drop("guard_line")
    return out.select("file", "ord", "line", "name", "var", "position")


def traced_flow(nodes: DataFrame, hits: DataFrame, taint: DataFrame) -> DataFrame:
    """(file, ord, var, flow): each hit's variable traced back over its last assignment, source first (G-20); a flow is whole, however long.

    It begins where nothing is assigned, no variable is, or a variable comes up a second time. Files are gone through one by one.
    """
    w = Window.partitionBy("file", "name").orderBy(F.desc("line"), F.desc("ord"))
    last = nodes.where("node_type = 'assign'").withColumn("r", F.row_number().over(w)).where("r = 1")
    none = F.lit(None).cast("long")
    at = last.select("file", F.col("name").alias("var"), "line", F.get(F.transform(F.filter("args", lambda a: a["arg_type"] == "var"), lambda a: a["value"]), 0).alias("other"), none.alias("ord"), F.lit(False).alias("hit"))
    ends = hits.select("file", "var", "line", F.col("name").alias("other"), "ord", F.lit(True).alias("hit"))
    rows = at.unionByName(ends).repartition("file").sortWithinPartitions("file", "hit", "ord", "var")
    return rows.mapInArrow(_traced, f"file string, ord bigint, var string, flow array<{STEP}>")


def _traced(batches):
    file, last = None, {}

    def flow(var: str, line: int, sink: str) -> list[dict]:
        steps, at, seen = [(line, f"sink {sink}")], var, set()
        while at is not None and at not in seen:
            seen.add(at)
            if at not in last:
                steps.append((0, f"source {at}"))
                break
            steps.append((last[at][0], f"assign {at}"))
            at = last[at][1]
        return [{"file": file, "line": n, "message": m} for n, m in reversed(steps)]

    step = pa.struct([("file", pa.string()), ("line", pa.int32()), ("message", pa.string())])
    for b in batches:
        out = []
        for f, var, line, other, ord_, hit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if f != file:
                file, last = f, {}
            if hit:
                out.append((f, ord_, var, flow(var, line, other)))
            else:
                last[var] = line, other
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.list_(step)), strict=True)], ["file", "ord", "var", "flow"])
