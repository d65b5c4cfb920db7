"""Call graph, reachability with shortest paths, ancestors and components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import predicates as P
from ..plans.fixpoint import durable, fixpoint
from ..plans.fixpoint import large as merged
from .scopes import with_scope

#: Links of a group beyond which it is joined round by round.
LARGE = 1_000_000


def call_edges(nodes: DataFrame) -> DataFrame:
    """(caller, callee, file, line): the first call site of each pair, by bare function name (G-21)."""
    known = nodes.where("node_type = 'def'").select(F.col("name").alias("callee")).distinct()
    inside = with_scope(nodes).where("node_type = 'call' AND scope_name IS NOT NULL").select(F.col("scope_name").alias("caller"), P.last_segment(F.col("name")).alias("callee"), "file", "line")
    return inside.join(known, "callee").groupBy("caller", "callee").agg(F.min(F.struct("file", "line")).alias("at")).select("caller", "callee", "at.file", "at.line")


def entry_points(nodes: DataFrame, custom: list[str] | None = None) -> DataFrame:
    """(name, file, line, kind) of definitions that the outside can call (F-06)."""
    kind = P.entry_kind(F.col("name"), F.col("args"), custom)
    return nodes.where("node_type = 'def'").select("name", "file", "line", kind.alias("kind")).where("kind IS NOT NULL")


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, entry, parent, hops): breadth first from entries(name); each function's smallest parent at its least distance (G-22)."""
    edges = durable(edges.select("caller", "callee").distinct())
    start = entries.select("name").distinct().select("name", F.col("name").alias("entry"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hops"))

    def step(delta: DataFrame) -> DataFrame:
        out = delta.join(edges, F.col("name") == F.col("caller")).groupBy("callee").agg(F.min(F.struct("entry", "name")).alias("m"), F.max("hops").alias("h"))
        return out.select(F.col("callee").alias("name"), "m.entry", F.col("m.name").alias("parent"), (F.col("h") + 1).alias("hops"))

    return fixpoint(start, step, ["name"])


def paths(reached: DataFrame) -> DataFrame:
    """(name, path): functions from the entry to each reached one. Parents form a tree, so this ends whatever its depth."""
    now = reached.where("parent IS NULL").select("name", F.array("name").alias("path"))
    out = now
    while True:
        now = durable(reached.where("parent IS NOT NULL").select("name", "parent").join(now.select(F.col("name").alias("parent"), "path"), "parent").select("name", F.concat("path", F.array("name")).alias("path")))
        if now.isEmpty():
            return out
        out = out.unionByName(now)


def tagged(found: DataFrame, nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Findings with status Live or Dormant, by the function around them; without entries all are Dormant (G-23)."""
    here = with_scope(nodes.select("file", "line", "ord", "node_type", "name")).select("file", "ord", F.col("scope_name").alias("func"))
    live = reached.select(F.col("name").alias("func"), "entry", "hops")
    out = found.join(merged(here), ["file", "ord"], "left").join(live, "func", "left")
    return out.withColumn("status", F.when(F.col("entry").isNotNull(), "Live").otherwise("Dormant"))


def heatmap(tagged_findings: DataFrame) -> DataFrame:
    """(file, live, dormant, total), most live first, then by name (K-08)."""
    live = F.sum((F.col("status") == "Live").cast("bigint"))
    dormant = F.sum((F.col("status") == "Dormant").cast("bigint"))
    return tagged_findings.groupBy("file").agg(live.alias("live"), dormant.alias("dormant"), F.count("*").alias("total")).orderBy(F.desc("live"), "file")


def ancestors(classes: DataFrame) -> DataFrame:
    """(name, ancestor, depth): every ancestor at its least distance; cycles end (G-24)."""
    parent = durable(classes.where("parent IS NOT NULL").select(F.col("name").alias("ancestor"), F.col("parent").alias("next")).distinct())
    start = classes.where("parent IS NOT NULL").select("name", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    return fixpoint(start, lambda d: d.join(parent, "ancestor").select("name", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth")), ["name", "ancestor"])


def components(links: DataFrame, group: str, large: int = LARGE) -> DataFrame:
    """(group, node, label): least node reachable inside each group of links(group, a, b) (G-25). Links with a null have no effect.

    Links stay inside their group, so each group is gone through once, in the task that holds it. Groups of more than ``large`` links, and
    nodes that are neither texts nor whole numbers, are joined round by round instead.
    """
    rows = links.select(group, "a", "b").where(F.col(group).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    kinds = [rows.schema[c].dataType for c in (group, "a", "b")]
    if kinds[1] != kinds[2] or not all(k == T.StringType() or isinstance(k, T.IntegralType) for k in kinds):
        return _in_rounds(rows, group)
    many = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > large).select(group)
    if many.isEmpty():
        return _by_group(rows, group)
    many = F.broadcast(durable(many))
    return _by_group(rows.join(many, group, "left_anti"), group).unionByName(_in_rounds(rows.join(many, group, "left_semi"), group))


def _by_group(links: DataFrame, group: str) -> DataFrame:
    kinds = [links.schema[c].dataType for c in (group, "a")]
    types = [to_arrow_type(k) for k in (*kinds, kinds[1])]

    def run(batches):
        key, root, out = None, {}, []

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def gone():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [group, "node", "label"])

        for batch in batches:
            for g, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != key:
                    out.extend((key, x, top(x)) for x in root)
                    key, root = g, {}
                a, b = top(root.setdefault(a, a)), top(root.setdefault(b, b))
                if a < b:
                    root[b] = a
                else:
                    root[a] = b
            if out:
                yield gone()
        out.extend((key, x, top(x)) for x in root)
        if out:
            yield gone()

    rows = links.select(group, "a", "b").repartition(group).sortWithinPartitions(group)
    return rows.mapInArrow(run, f"`{group}` {kinds[0].simpleString()}, node {kinds[1].simpleString()}, label {kinds[1].simpleString()}")


def _in_rounds(links: DataFrame, group: str) -> DataFrame:
    both = durable(links.select(group, "a", "b").unionByName(links.select(group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.select(group, F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [group, "b"]).groupBy(group, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [group, "node"]).select(group, "node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        # a label is a node itself: follow its label too, so long chains halve each round
        jump = step.select(group, F.col("node").alias("label"), F.col("label").alias("further"))
        new = durable(step.join(jump, [group, "label"]).select(group, "node", F.col("further").alias("label"), (F.col("moved") | (F.col("further") < F.col("label"))).alias("moved")))
        labels = new.select(group, "node", "label")
        if new.where("moved").isEmpty():
            return labels


def classified(edges: DataFrame, entries: DataFrame, sinks: DataFrame, reached: DataFrame) -> DataFrame:
    """(name, class) for a call graph drawing: a sink beats an entry, then reachable, then dormant (K-05)."""
    names = edges.select(F.col("caller").alias("name")).union(edges.select("callee")).distinct()
    flag = lambda df, c: df.select("name", F.lit(True).alias(c)).distinct()
    out = names.join(flag(entries, "e"), "name", "left").join(flag(sinks, "s"), "name", "left").join(flag(reached, "r"), "name", "left")
    return out.select("name", F.when(F.col("s"), "Sink").when(F.col("e"), "Entry").when(F.col("r"), "Reachable").otherwise("Dormant").alias("class"))
