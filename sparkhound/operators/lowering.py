"""Expression rows to the statements that control flow is made of (P-05).

Each tree row gives a few events, at its start or its end; sorted, the events are the statements in the order in which they
happen. What an expression yields goes into a variable of its own, ``%`` and its number, so arguments keep their places and
nested calls their order. An if gives branch, else and end around its parts, a case a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import large
from .exprs import children
from .intervals import with_level, with_nearest

IL = "file string, fn string, ord bigint, kind string, lhs string, callee string, args array<string>, line int"
_TREE = ["file", "fn_id"]
#: Rows whose children's values matter to them; a block, if or case hands on the value of its last child or branches.
_TAKES = ("app", "binary", "unary", "let", "assign", "return", "raise", "field", "tuple", "list", "record", "error")
_CHOOSES = ("if", "ternary", "case", "while")
_EVENT = "struct<at:bigint,phase:int,up:int,step:int,kind:string,lhs:string,callee:string,args:array<string>,line:int>"


def _temporary(expr_id: Column) -> Column:
    return F.concat(F.lit("%"), expr_id.cast("string"))


def operand(x: Column) -> Column:
    """How an expression is named as an argument: a variable or plain field by its name, a literal in quotes, any other by its own variable."""
    plain = x["kind"].isin("var", "field", "param") & (x["pre_order"] == x["subtree_end"]) & (x["name"] != "")
    return F.when(plain, x["name"]).when(x["kind"] == "literal", F.concat(F.lit('"'), F.coalesce(x["literal"], F.lit("")), F.lit('"'))).otherwise(_temporary(x["expr_id"]))


def _owned(exprs: DataFrame) -> DataFrame:
    """``fn`` of each row: the nearest function or lambda around it; outside of functions each constant's tree is a function of its own."""
    container = F.col("kind").isin("class", "module", "enum")
    rows = with_nearest(exprs, _TREE, container, "c", [F.col("kind")])
    rows = rows.withColumn("top", (F.col("fn_id") == "") & ~container & (F.col("depth") == F.col("c_level")))
    begins = F.col("kind").isin("function", "lambda") | F.col("top")
    rows = with_nearest(rows, _TREE, begins, "o", [F.col("expr_id"), F.col("top"), F.col("kind")])
    # a constant is in its own function; a function's or lambda's own row is not a statement of it
    own = F.when(F.col("top") & ~F.col("kind").isin("function", "lambda"), F.struct("expr_id", "top", "kind")).otherwise(F.col("o"))
    rows = rows.withColumn("o", own)
    root = (F.col("o.expr_id") == 0) & (F.col("o.kind") == "function")
    fn = F.when(root, F.col("fn_id")).otherwise(F.concat("fn_id", F.lit("/"), F.col("o.expr_id").cast("string")))
    return rows.where("o IS NOT NULL").withColumn("fn", fn).drop("c", "c_level", "o", "o_level", "top")


def lower(exprs: DataFrame) -> DataFrame:
    """Rows of IL for operators.cfg: assign, call, branch, else, end and return, in order.

    A call is a row of its own, in front of the assignment of its value. What a try, rescue or ensure holds follows in source order, and then
    a call named "try". Lambdas and functions inside functions are functions of their own, called fn_id/number; an imported name gives nothing.
    """
    kids = children(exprs).withColumnRenamed("parent_id", "expr_id")
    parent = exprs.select(*_TREE, F.col("expr_id").alias("parent_id"), F.col("kind").alias("p_kind"), F.col("line").alias("p_line"))
    count = F.when(F.col("kids").isNull(), 0).otherwise(F.size("kids"))
    rows = exprs.join(large(kids), [*_TREE, "expr_id"], "left").withColumn("n", count).join(large(parent), [*_TREE, "parent_id"], "left")
    # the last child of a block, and what an if or case chooses, stand for the row around them
    siblings = Window.partitionBy(*_TREE, "parent_id")
    rows = rows.withColumn("last", F.col("child_ix") == F.max("child_ix").over(siblings))
    handed = F.coalesce((F.col("p_kind") == "block") & F.col("last") | F.col("p_kind").isin(*_CHOOSES) & (F.col("child_ix") > 0), F.lit(False))
    rows = rows.withColumns({"handed": handed, "taken": F.coalesce(F.col("p_kind").isin(*_TAKES), F.lit(False))})
    rows = with_nearest(rows, _TREE, ~F.col("handed"), "u", [F.col("taken")])
    rows = rows.withColumn("used", F.when(F.col("handed"), F.coalesce("u.taken", F.lit(False))).otherwise(F.col("taken"))).drop("u", "u_level")
    rows = _owned(rows)

    values = F.transform("kids", operand)
    args = F.transform(F.filter("kids", lambda k: k["child_ix"] >= 0), operand)
    none, no_args = F.lit(None).cast("string"), F.array().cast("array<string>")

    def event(kind: str, lhs=none, callee=none, args=no_args, step: int = 0, enter: bool = False, line: str = "line") -> Column:
        at = F.col("pre_order") if enter else F.col("subtree_end")
        fields = (at.alias("at"), F.lit(-1 if enter else 1).alias("phase"), (-F.col("depth")).alias("up"), F.lit(step).alias("step"), F.lit(kind).alias("kind"), lhs.alias("lhs"), callee.alias("callee"), F.coalesce(args, no_args).alias("args"), F.col(line).alias("line"))
        return F.struct(*fields).cast(_EVENT)

    kind, ix, p_kind, own = F.col("kind"), F.col("child_ix"), F.col("p_kind"), _temporary(F.col("expr_id"))
    value = F.when(kind == "block", F.when(F.col("n") > 0, F.array(operand(F.element_at("kids", -1))))).otherwise(values)
    branches = F.col("n") - 1
    ends = F.when(kind.isin("if", "ternary", "while"), F.least(F.col("n"), F.lit(1))).when(kind == "case", F.greatest(branches - 1, F.lit(0))).otherwise(0)
    p_branches = F.max("child_ix").over(siblings)  # of a case: its branches' number, as child 0 is what it looks at
    rows = rows.withColumn("p_branches", p_branches)
    mine = F.struct("kind", "name", "literal", "expr_id", "pre_order", "subtree_end")
    of_if, of_case = p_kind.isin("if", "ternary", "while"), p_kind == "case"
    chosen = F.coalesce(of_if | of_case, F.lit(False)) & (ix > 0) & F.col("used")
    events = {
        "else": (F.coalesce(of_if & (ix == 2), F.lit(False)), event("else", enter=True, line="p_line")),
        "arm": (F.coalesce(of_case & (ix >= 1) & (ix < F.col("p_branches")), F.lit(False)), event("branch", enter=True, line="p_line")),
        "call": (kind == "app", event("call", callee=F.col("name"), args=args)),
        "value": (
            F.col("used") & (kind.isin("app", "binary", "unary", "tuple", "list", "record", "block") | ((kind == "field") & (F.col("n") > 0))),
            event("assign", own, F.when(kind == "app", F.col("name")).when(kind.isin("binary", "unary"), F.col("op")), value, 1),
        ),
        "bind": (kind.isin("let", "assign") & ~F.coalesce(F.col("name") == "", F.lit(True)), event("assign", F.col("name"), none, values, 2)),
        "leave": (kind.isin("return", "raise", "error"), event("return", args=values, step=3)),
        "try": (kind == "try", event("call", callee=F.lit("try"), args=F.array(F.lit("%try")), step=3)),
        "chosen": (chosen, event("assign", _temporary(F.col("parent_id")), none, F.array(operand(mine)), 7)),
        "cond": (F.coalesce(of_if & (ix == 0), F.lit(False)), event("branch", args=F.array(operand(mine)), step=8, line="p_line")),
        "next": (F.coalesce(of_case & (ix >= 1) & (ix < F.col("p_branches")), F.lit(False)), event("else", step=9, line="p_line")),
    }
    one = F.filter(F.array(*[F.when(when, e) for when, e in events.values()]), lambda e: e.isNotNull())
    closed = F.when(ends > 0, F.transform(F.sequence(F.lit(1), ends), lambda _: event("end", step=4))).otherwise(F.array().cast(f"array<{_EVENT}>"))
    order = Window.partitionBy("file", "fn").orderBy("e.at", "e.phase", "e.up", "e.step")
    out = rows.select("file", "fn", F.explode(F.concat(one, closed)).alias("e"))
    return out.select("file", "fn", F.row_number().over(order).cast("bigint").alias("ord"), "e.kind", "e.lhs", "e.callee", "e.args", "e.line")


def parameters(exprs: DataFrame) -> DataFrame:
    """(file, fn, params) of functions and lambdas that have any."""
    rows = _owned(exprs).where("kind = 'param' AND name <> ''")
    p = rows.groupBy("file", "fn").agg(F.sort_array(F.collect_list(F.struct("pre_order", "name"))).alias("p"))
    return p.select("file", "fn", F.transform("p", lambda x: x["name"]).alias("params"))
