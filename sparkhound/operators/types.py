"""Kinds of values: which expressions may be nil, or a result that can be an error.

Values flow from literals and calls into bindings, from bindings into variables, from blocks' last rows and from branches into what is
around them. What reaches an expression is a closure over these edges, gone through function by function as taint is; the kinds that
reach it are joined: one kind is itself, safe and nullable are nullable, anything else is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..plans.fixpoint import large
from .exprs import _BY, _hit
from .taint import propagate

_BRANCHES = ("if", "ternary", "case")


def value_edges(exprs: DataFrame) -> DataFrame:
    """(file, fn_id, src, dst): the value of row src is one that row dst may have."""
    rows = exprs.select(*_BY, "expr_id", "parent_id", "child_ix", "kind", "name", "pre_order")
    parents = exprs.select(*_BY, F.col("expr_id").alias("parent_id"), F.col("kind").alias("p_kind"))
    last = F.col("child_ix") == F.max("child_ix").over(Window.partitionBy(*_BY, "parent_id"))
    up = rows.where("parent_id IS NOT NULL").withColumn("last", last).join(large(parents), [*_BY, "parent_id"])
    up = up.where(F.col("p_kind").isin("let", "assign", "block") & F.col("last") | F.col("p_kind").isin(*_BRANCHES) & (F.col("child_ix") > 0))
    # a variable has what was bound to its name last, in the order of the source
    bound = F.last(F.when(F.col("kind").isin("let", "assign", "param"), F.col("expr_id")), ignorenulls=True).over(Window.partitionBy(*_BY, "name").orderBy("pre_order").rowsBetween(Window.unboundedPreceding, -1))
    uses = rows.where("kind IN ('let', 'assign', 'param', 'var') AND name <> ''").withColumn("src", bound).where("kind = 'var' AND src IS NOT NULL")
    return up.select(*_BY, F.col("expr_id").alias("src"), F.col("parent_id").alias("dst")).unionByName(uses.select(*_BY, "src", F.col("expr_id").alias("dst")))


def own_kinds(exprs: DataFrame, returns: DataFrame, language: Column) -> DataFrame:
    """(file, fn_id, expr_id, k): kinds that rows have by themselves. Calls are looked up by their whole name, then by its last part."""
    table = returns.groupBy("language", "name").agg(F.min("kind").alias("k"))  # people write it
    calls = exprs.where("kind = 'app'").select(*_BY, "expr_id", "name", language.alias("language"))
    short = table.select("language", F.col("name").alias("tail"), F.col("k").alias("k2"))
    found = calls.join(F.broadcast(table), ["language", "name"], "left").withColumn("tail", P.last_segment(F.col("name"))).join(F.broadcast(short), ["language", "tail"], "left")
    found = found.select(*_BY, "expr_id", F.coalesce("k", "k2", F.lit("unknown")).alias("k"))
    bound = exprs.where("kind IN ('let', 'assign', 'param') AND name <> ''").groupBy(*_BY, "name").agg(F.min("pre_order").alias("first"))
    free = exprs.where("kind = 'var'").join(large(bound), [*_BY, "name"], "left").where("first IS NULL OR first >= pre_order")
    kids = exprs.where("parent_id IS NOT NULL").groupBy(*_BY, F.col("parent_id").alias("expr_id")).agg(F.max("child_ix").alias("top"))
    open_ = exprs.where("kind = 'if'").join(large(kids), [*_BY, "expr_id"]).where("top = 1")  # without else it may yield nothing
    of = lambda df, k: df.select(*_BY, "expr_id", k.alias("k"))
    literal = F.when(F.col("literal_kind") == "null", "nullable").otherwise("safe")
    plain = exprs.where("kind IN ('binary', 'unary', 'list', 'tuple', 'record', 'lambda')")
    blank = exprs.where("kind IN ('field', 'param', 'while', 'try')")
    return found.unionByName(of(free, F.lit("unknown"))).unionByName(of(open_, F.lit("nullable"))).unionByName(of(exprs.where("kind = 'literal'"), literal)).unionByName(of(plain, F.lit("safe"))).unionByName(of(blank, F.lit("unknown")))


def joined(kinds: Column) -> Column:
    """The least kind that covers all."""
    one = F.array_distinct(kinds)
    return F.when(F.size(one) == 1, one[0]).when(F.size(F.array_except(one, F.array(F.lit("safe"), F.lit("nullable")))) == 0, "nullable").otherwise("unknown")


def kinds(exprs: DataFrame, returns: DataFrame, language: Column) -> DataFrame:
    """(file, fn_id, expr_id, value): safe, nullable, result or unknown for each row that yields a value.

    ``language`` is a column of ``exprs`` or a literal. Rows that take part in no edge and have no kind of their own, such as functions, are left out.
    """
    key = F.to_json(F.struct(*_BY))
    seeds = own_kinds(exprs, returns, language).select(key.alias("file"), F.col("expr_id").cast("string").alias("var"), F.col("k").alias("field"), F.lit("").alias("source"))
    none = F.lit(None).cast("string")
    edges = value_edges(exprs).select(key.alias("file"), F.col("src").cast("string").alias("src"), none.alias("src_field"), F.col("dst").cast("string").alias("dst"), none.alias("dst_field"))
    reached = propagate(seeds, edges).groupBy("file", "var").agg(F.collect_set("field").alias("ks"))
    of = F.from_json("file", "file string, fn_id string")
    return reached.select(of["file"].alias("file"), of["fn_id"].alias("fn_id"), F.col("var").cast("long").alias("expr_id"), joined(F.col("ks")).alias("value"))


def ignored_results(exprs: DataFrame, known: DataFrame) -> DataFrame:
    """Calls that return a result which nothing looks at: rows of a block that are not its last."""
    parents = exprs.where("kind = 'block'").select(*_BY, F.col("expr_id").alias("parent_id"))
    last = F.col("child_ix") == F.max("child_ix").over(Window.partitionBy(*_BY, "parent_id"))
    rows = exprs.withColumn("last", last).where("kind = 'app' AND NOT last").join(large(parents), [*_BY, "parent_id"], "left_semi")
    return _hit(rows.join(large(known.where("value = 'result'")), [*_BY, "expr_id"], "left_semi"), "ignored-result", "Warning")


def unchecked_nullables(exprs: DataFrame, known: DataFrame) -> DataFrame:
    """Fields and methods of variables that may be nil, and of calls that may return nil."""
    rows = exprs.where("kind IN ('app', 'field')")
    var = F.last(F.when(F.col("kind").isin("let", "assign", "param"), F.col("expr_id")), ignorenulls=True).over(Window.partitionBy(*_BY, "root").orderBy("pre_order").rowsBetween(Window.unboundedPreceding, -1))
    named = exprs.where("kind IN ('let', 'assign', 'param', 'app', 'field') AND name <> ''").withColumn("root", F.when(F.col("kind").isin("app", "field"), P.first_segment(F.col("name"))).otherwise(F.col("name"))).withColumn("at", var)
    nil = known.where("value = 'nullable'")
    by_name = named.where("kind IN ('app', 'field') AND name LIKE '%.%' AND at IS NOT NULL").join(large(nil.withColumnRenamed("expr_id", "at")), [*_BY, "at"], "left_semi").select(rows.columns)
    receiver = exprs.where("child_ix = -1").join(large(nil), [*_BY, "expr_id"], "left_semi").select(*_BY, F.col("parent_id").alias("expr_id"))
    by_call = rows.join(large(receiver), [*_BY, "expr_id"], "left_semi")
    return _hit(by_name.unionByName(by_call).dropDuplicates([*_BY, "expr_id"]), "unchecked-nullable", "Warning")
