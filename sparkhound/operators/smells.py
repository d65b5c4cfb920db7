"""Code smells over node rows: each a function nodes -> rows (rule, severity, file, line, subject, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import words as W
from ..plans.fixpoint import durable
from .reach import ancestors, components
from .scopes import body_sizes, scoped, with_scope


@dataclass(frozen=True)
class Limits:
    complexity: tuple[int, int] = (10, 20)
    params: tuple[int, int] = (5, 8)
    nesting: tuple[int, int] = (5, 7)
    methods: int = 20
    window: int = 8
    occurrences: int = 4
    long_method: tuple[int, int] = (30, 50)
    conditional: int = 3
    chain: int = 5
    clump: int = 3
    match: tuple[int, int] = (5, 10)
    spaghetti: tuple[int, int] = (60, 100)
    lazy: int = 3
    class_lines: tuple[int, int] = (200, 500)
    hub: tuple[int, int] = (12, 20)
    shotgun: int = 5


DEFAULT = Limits()


def _graded(df: DataFrame, rule: str, value: Column, limits: tuple[int, int], low: str = "Medium", high: str = "High") -> DataFrame:
    sev = F.when(value >= limits[1], high).when(value >= limits[0], low)
    return df.select(F.lit(rule).alias("rule"), sev.alias("severity"), "file", F.col("line").cast("int").alias("line"), "subject", value.cast("bigint").alias("value")).where("severity IS NOT NULL")


def is_decision(name: Column) -> Column:
    return P.word_bounded(F.lower(name), W.DECISIONS)


def high_complexity(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    inside = with_scope(nodes).where("scope_line IS NOT NULL AND node_type <> 'def'")
    n = inside.groupBy("file", F.col("scope_line").alias("line"), F.col("scope_name").alias("subject")).agg((F.sum(is_decision(F.col("name")).cast("bigint")) + 1).alias("n"))
    return _graded(n, "HighComplexity", F.col("n"), limits.complexity)


def long_method(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return _graded(body_sizes(nodes).withColumnsRenamed({"func_name": "subject", "start_line": "line"}), "LongMethod", F.col("n_nodes"), limits.long_method)


def spaghetti(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return _graded(body_sizes(nodes).withColumnsRenamed({"func_name": "subject", "start_line": "line"}), "SpaghettiCode", F.col("n_nodes"), limits.spaghetti)


def long_parameter_list(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    defs = nodes.where("node_type = 'def' AND name NOT IN ('initialize', 'new')").where(~P.test_file(F.col("file"))).withColumn("subject", F.col("name"))
    return _graded(defs, "LongParameterList", F.size("args"), limits.params)


def deep_nesting(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    scope = P.word_bounded(F.lower(F.col("name")), ["if", "unless", "case", "while", "loop", "each", "begin", "do", "for", "until"])
    inside = with_scope(nodes).where("scope_line IS NOT NULL AND node_type = 'control'").where(scope)
    n = inside.groupBy("file", F.col("scope_line").alias("line"), F.col("scope_name").alias("subject")).agg(F.count("*").alias("n"))
    return _graded(n, "DeepNesting", F.col("n"), limits.nesting)


def god_object(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    typed = with_scope(nodes, ("class", "module", "enum"), prefix="type").where("node_type = 'def'")
    n = typed.groupBy("file", F.coalesce("type_name", "file").alias("subject")).agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return _graded(n, "GodObject", F.col("n"), (limits.methods, limits.methods * 1000), "High")


def complex_conditional(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    n = F.regexp_count("name", F.lit(r"&&|\|\|")) + F.aggregate("args", F.lit(0), lambda a, x: a + F.regexp_count(x["value"], F.lit(r"&&|\|\|")))
    rows = nodes.where("node_type = 'control'").withColumn("subject", F.col("name")).withColumn("n", n)
    return _graded(rows, "ComplexConditional", F.col("n"), (limits.conditional, 1 << 30))


def message_chain(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    rows = nodes.where("node_type = 'call'").withColumn("subject", F.col("name"))
    return _graded(rows, "MessageChain", F.size(F.split("name", r"\.")), (limits.chain, 1 << 30))


def flag_argument(nodes: DataFrame) -> DataFrame:
    args = nodes.where("node_type = 'def'").select("file", "line", F.explode("args.value").alias("subject")).where(P.flag_name(F.col("subject")))
    return args.select(F.lit("FlagArgument").alias("rule"), F.lit("Low").alias("severity"), "file", "line", "subject", F.lit(1).cast("bigint").alias("value"))


def complex_match(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    branches = F.expr("try_cast(args[0].value AS int)")
    rows = nodes.where("node_type = 'control' AND name = 'case' AND size(args) > 0").withColumn("subject", F.col("name"))
    return _graded(rows, "ComplexMatch", branches, limits.match)


def dead_code(nodes: DataFrame) -> DataFrame:
    """The first row after an unconditional terminator in the same function (W-05): the terminator's own line aside, no
    branch may be open, which a control row in the two lines before the terminator would show."""
    w = Window.partitionBy("file").orderBy("line", "ord")
    rows = with_scope(nodes.where("node_type <> 'import'")).withColumns(
        {"p_kind": F.lag("node_type").over(w), "p_line": F.lag("line").over(w)}
    )
    control = F.max(F.when(F.col("node_type") == "control", F.col("line"))).over(Window.partitionBy("file").orderBy("line").rangeBetween(-3, -1))
    rows = rows.withColumn("open", control)
    hit = rows.where("p_kind = 'terminator' AND node_type NOT IN ('def', 'class', 'module', 'enum', 'control', 'terminator') AND line > p_line AND (open IS NULL OR open < p_line - 2)")
    return hit.select(F.lit("DeadCode").alias("rule"), F.lit("Medium").alias("severity"), "file", "line", F.col("name").alias("subject"), F.lit(1).cast("bigint").alias("value"))


def shotgun_surgery(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Receivers that a file calls at least five times (A-05)."""
    calls = nodes.where("node_type = 'call'").groupBy("file", P.first_segment(F.col("name")).alias("subject")).agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return _graded(calls, "ShotgunSurgery", F.col("n"), (limits.shotgun, 1 << 30))


def hub_like_module(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Files with many distinct callees (A-04)."""
    n = nodes.where("node_type = 'call'").groupBy("file").agg(F.count_distinct("name").alias("n"), F.min("line").alias("line")).withColumn("subject", F.col("file"))
    return _graded(n, "HubLikeModule", F.col("n"), limits.hub)


def feature_envy(nodes: DataFrame, least: int = 5, share: float = 0.7) -> DataFrame:
    """Functions whose foreign accesses go mostly to one receiver (A-08)."""
    acc = with_scope(nodes).where("node_type = 'call' AND scope_line IS NOT NULL").groupBy("file", "scope_line", "scope_name", P.first_segment(F.col("name")).alias("receiver")).agg(F.count("*").alias("n"))
    best = acc.groupBy("file", "scope_line", "scope_name").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min_by("receiver", F.struct(-F.col("n"), "receiver")).alias("receiver"))
    hit = best.where((F.col("total") >= least) & (F.col("most") / F.col("total") >= share))
    return hit.select(F.lit("FeatureEnvy").alias("rule"), F.lit("Medium").alias("severity"), "file", F.col("scope_line").alias("line"), F.concat_ws(" -> ", "scope_name", "receiver").alias("subject"), F.col("most").alias("value"))


def data_clumps(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Parameter pairs that stand together in at least three definitions of at least two files (J-16)."""
    names = F.array_sort(F.array_distinct(F.transform(F.filter("args", lambda a: a["arg_type"] == "var"), lambda a: a["value"])))
    defs = nodes.where("node_type = 'def' AND size(args) > 1").select("file", "line", names.alias("p"))
    pairs = defs.select("file", "line", F.posexplode("p").alias("i", "a"), "p").select("file", "line", "a", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("b"))
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.min(F.struct("file", "line")).alias("at")).where(f"n >= {limits.clump} AND files >= 2")
    return n.select(F.lit("DataClump").alias("rule"), F.lit("Low").alias("severity"), "at.file", "at.line", F.concat_ws(",", "a", "b").alias("subject"), F.col("n").alias("value"))


def normalised() -> Column:
    """A row without its names: calls keep name and arity, SQL calls their statement (P-11)."""
    n = F.size("args").cast("string")
    statement = F.get(F.filter("args", lambda a: F.substring(F.lower(a["value"]), 1, 6).isin(*W.SQL_WORDS)), 0)
    kind = F.col("node_type")
    return (
        F.when((kind == "call") & statement.isNotNull(), F.concat_ws("|", F.lit("Call"), "name", F.md5(statement["value"])))
        .when(kind == "call", F.concat_ws("|", F.lit("Call"), "name", n))
        .when((kind == "assign") & F.col("name").startswith("@"), "Assign|@inst|1")
        .when(kind == "assign", F.concat_ws("|", F.lit("Assign|_"), n))
        .when(kind == "def", F.concat_ws("|", F.lit("Def|_"), n))
        .when(kind.isin("ignored_return", "non_atomic_file_op", "unbounded_read", "toctou"), F.concat_ws("|", kind, "name", n))
        .otherwise(F.concat_ws("|", kind, F.lit("_|0")))
    )


def duplicate_windows(nodes: DataFrame, limits: Limits = DEFAULT, row: Column | None = None) -> DataFrame:
    """(hash, n, files, file, line): windows of eight normalised rows at four or more places of two or more files (W-03, A-07)."""
    k = limits.window
    w = Window.partitionBy("file").orderBy("line", "ord")
    parts = nodes.withColumn("norm", normalised() if row is None else row)
    frame = F.collect_list("norm").over(w.rowsBetween(0, k - 1))
    marks = parts.select("file", "line", frame.alias("frame")).where(F.size("frame") == k).select("file", "line", F.md5(F.array_join("frame", "|")).alias("hash"))
    n = marks.groupBy("hash").agg(F.count_distinct("file", "line").alias("n"), F.count_distinct("file").alias("files"), F.min(F.struct("file", "line")).alias("at"))
    return n.where(f"n >= {limits.occurrences} AND files >= 2").select("hash", "n", "files", "at.file", "at.line")


def dry_violation(nodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return duplicate_windows(nodes, limits).select(F.lit("DRYViolation").alias("rule"), F.lit("Medium").alias("severity"), "file", "line", F.col("hash").alias("subject"), F.col("n").alias("value"))


# -- concurrency


def orphaned_spawn(nodes: DataFrame) -> DataFrame:
    """spawn in a function without rescue or ensure."""
    inside = with_scope(nodes).where("scope_line IS NOT NULL")
    safe = inside.where(P.word_bounded(F.lower(F.col("name")), ["rescue", "ensure", "exception_handler"])).select("file", "scope_line").distinct()
    hit = inside.where("node_type = 'call' AND name = 'spawn'").join(safe, ["file", "scope_line"], "left_anti")
    return hit.select(F.lit("OrphanedSpawn").alias("rule"), F.lit("Medium").alias("severity"), "file", "line", F.col("scope_name").alias("subject"), F.lit(1).cast("bigint").alias("value"))


def _channel_calls(nodes: DataFrame) -> DataFrame:
    verb = P.last_segment(F.col("name"))
    return nodes.where("node_type = 'call' AND name LIKE '%.%'").select("file", "line", "ord", verb.alias("verb"), F.expr("left(name, length(name) - length(substring_index(name, '.', -1)) - 1)").alias("channel"))


def muted_pack(nodes: DataFrame) -> DataFrame:
    """A channel that is sent to and never received from in its file."""
    calls = _channel_calls(nodes)
    got = calls.where("verb IN ('receive', 'receive?')").select("file", "channel").distinct()
    sent = calls.where("verb = 'send'").groupBy("file", "channel").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    return sent.join(got, ["file", "channel"], "left_anti").select(F.lit("MutedPack").alias("rule"), F.lit("Medium").alias("severity"), "file", "line", F.col("channel").alias("subject"), F.col("n").alias("value"))


def dead_letter(nodes: DataFrame) -> DataFrame:
    """A channel closed before anything was received from it (W-04)."""
    calls = _channel_calls(nodes).where("verb IN ('close', 'receive', 'receive?')")
    w = Window.partitionBy("file", "channel").orderBy("line", "ord").rowsBetween(Window.unboundedPreceding, -1)
    got = F.coalesce(F.max((F.col("verb") != "close").cast("int")).over(w), F.lit(0))
    later = F.max((F.col("verb") != "close").cast("int")).over(Window.partitionBy("file", "channel"))
    hit = calls.withColumn("got", got).withColumn("later", later).where("verb = 'close' AND got = 0 AND later = 1")
    return hit.select(F.lit("DeadLetter").alias("rule"), F.lit("High").alias("severity"), "file", "line", F.col("channel").alias("subject"), F.lit(1).cast("bigint").alias("value"))


# -- classes


def class_table(nodes: DataFrame) -> DataFrame:
    """(name, file, line, ord, end_line, loc, parent, is_abstract, methods, n_methods): a row for each definition of a class."""
    w = Window.partitionBy("file").orderBy("line", "ord")
    types = nodes.where("node_type IN ('class', 'module', 'enum')").withColumn("next_line", F.lead("line").over(w))
    last = nodes.groupBy("file").agg(F.max("line").alias("last_line"))
    typed = with_scope(nodes, ("class", "module", "enum"), prefix="type").where("node_type = 'def' AND type_line IS NOT NULL")
    methods = typed.groupBy("file", F.col("type_line").alias("line")).agg(F.sort_array(F.collect_set("name")).alias("methods"))
    out = types.where("node_type = 'class'").join(last, "file").join(methods, ["file", "line"], "left")
    out = out.select(
        "name", "file", "line", "ord", F.coalesce(F.col("next_line") - 1, "last_line").alias("end_line"), F.nullif(F.col("metadata")["parent"], F.lit("")).alias("parent"),
        F.coalesce(F.col("metadata")["abstract"] == "true", F.lit(False)).alias("is_abstract"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"),
    )
    return out.withColumns({"loc": F.col("end_line") - F.col("line"), "n_methods": F.size("methods")})


def last_of_each(classes: DataFrame) -> DataFrame:
    """The definition that a class name stands for when it is looked up as a parent: the last one (J-15)."""
    at = [F.desc(c) for c in ("file", "ord", "line") if c in classes.columns]
    return classes.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(*at))).where("_r = 1").drop("_r")


def _class_finding(df: DataFrame, rule: str, severity: Column | str, value: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(rule).alias("rule"), sev.alias("severity"), "file", "line", F.col("name").alias("subject"), value.cast("bigint").alias("value")).where("severity IS NOT NULL")


def lazy_class(classes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    hit = classes.where(f"n_methods BETWEEN 1 AND {limits.lazy - 1} AND NOT is_abstract").where(~F.col("name").rlike("(?:Error|Exception|Config|Test|Spec)$"))
    return _class_finding(hit, "LazyClass", "Low", F.col("n_methods"))


def large_class(classes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    low, high = limits.class_lines
    return _class_finding(classes, "LargeClass", F.when(F.col("loc") >= high, "High").when(F.col("loc") >= low, "Medium"), F.col("loc"))


def blob(classes: DataFrame) -> DataFrame:
    return _class_finding(classes, "Blob", F.when((F.col("n_methods") >= 25) & (F.col("loc") >= 300), "High").when((F.col("n_methods") >= 15) & (F.col("loc") >= 200), "Medium"), F.col("n_methods"))


def children(classes: DataFrame) -> DataFrame:
    return classes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count_distinct("name").alias("n_children"))


def base_class_should_be_abstract(classes: DataFrame, least: int = 3) -> DataFrame:
    return _class_finding(classes.join(children(classes), "name").where(f"n_children >= {least} AND NOT is_abstract"), "BaseClassShouldBeAbstract", "Low", F.col("n_children"))


def speculative_generality(classes: DataFrame) -> DataFrame:
    n = classes.join(children(classes), "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return _class_finding(n.where("is_abstract AND n_children < 2"), "SpeculativeGenerality", "Low", F.col("n_children"))


def deep_inheritance(classes: DataFrame, most: int = 4) -> DataFrame:
    depth = ancestors(last_of_each(classes)).groupBy("name").agg((F.max("depth") + 1).alias("depth"))  # the class itself counts
    return _class_finding(classes.join(depth, "name").where(f"depth > {most}"), "DeepInheritance", "Medium", F.col("depth"))


def tradition_breaker(classes: DataFrame) -> DataFrame:
    p = last_of_each(classes).select(F.col("name").alias("parent"), F.col("n_methods").alias("p_methods"))
    return _class_finding(classes.join(p, "parent").where("p_methods >= 10 AND n_methods <= 2 AND loc > 1000"), "TraditionBreaker", "Medium", F.col("p_methods"))


def refused_bequest(classes: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """Short overrides of an ancestor's method, constructors and abstract ancestors aside (J-18)."""
    one = last_of_each(classes)
    up = ancestors(one).join(one.where("NOT is_abstract").select(F.col("name").alias("ancestor"), F.explode("methods").alias("method")), "ancestor")
    mine = classes.select("name", "file", F.col("line").alias("type_line"), F.explode("methods").alias("method")).where("method <> 'initialize'")
    both = mine.join(up, ["name", "method"]).select("name", "file", "type_line", "method").distinct()
    sizes = with_scope(nodes, ("class", "module", "enum"), prefix="type")
    w = Window.partitionBy("file").orderBy("line", "ord")
    defs = sizes.where("node_type = 'def'").withColumn("size", F.coalesce(F.lead("line").over(w) - F.col("line"), F.lit(1))).select("file", "type_line", F.col("name").alias("method"), "line", "size")
    hit = both.join(defs, ["file", "type_line", "method"]).where(f"size <= {most}")
    return hit.select(F.lit("RefusedParentBequest").alias("rule"), F.lit("Low").alias("severity"), "file", "line", F.concat_ws(".", "name", "method").alias("subject"), F.col("size").cast("bigint").alias("value"))


def knows_derived(classes: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """A base of three or more whose body names one of its children."""
    kids = classes.where("parent IS NOT NULL").select(F.col("parent").alias("name"), F.col("name").alias("child"))
    inside = with_scope(nodes, ("class",), prefix="class").where("class_line IS NOT NULL AND node_type IN ('call', 'assign')").select(F.col("class_name").alias("name"), "file", "class_line", "line", F.col("name").alias("used"))
    hit = inside.join(kids, "name").where(F.contains("used", "child")).join(children(classes).where(f"n_children >= {least}"), "name")
    return hit.groupBy("name", "file", "class_line").agg(F.min("line").alias("line"), F.count_distinct("child").alias("n")).select(F.lit("BaseClassKnowsDerivedClass").alias("rule"), F.lit("Medium").alias("severity"), "file", "line", F.col("name").alias("subject"), F.col("n").alias("value"))


def parallel_inheritance(classes: DataFrame) -> DataFrame:
    """Class names made of two other class names (J-17)."""
    cut = classes.where(F.length("name") > 1).select("name", "file", "line", F.explode(F.sequence(F.lit(1), F.length("name") - 1)).alias("k")).select(
        "name", "file", "line", F.expr("left(name, k)").alias("head"), F.expr("substring(name, k + 1)").alias("tail")
    )
    names = classes.select("name").distinct()
    hit = cut.join(names.withColumnRenamed("name", "head"), "head").join(names.withColumnRenamed("name", "tail"), "tail")
    return _class_finding(hit.select("name", "file", "line").distinct(), "ParallelInheritance", "Low", F.lit(1))


def anti_singleton(nodes: DataFrame) -> DataFrame:
    """Class variables assigned inside a class."""
    hit = with_scope(nodes, ("class",), prefix="class").where("node_type = 'assign' AND name LIKE '@@%' AND class_line IS NOT NULL").where(~F.col("name").rlike("^@@(?:instance|mutex|lock|config|logger)"))
    return hit.select(F.lit("AntiSingleton").alias("rule"), F.lit("Medium").alias("severity"), "file", "line", F.concat_ws(".", "class_name", "name").alias("subject"), F.lit(1).cast("bigint").alias("value"))


def data_class(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """At least two properties and no behaviour."""
    inside = with_scope(nodes, ("class", "module", "enum"), prefix="type").where("type_line IS NOT NULL")
    prop = (F.col("node_type") == "call") & P.last_segment(F.col("name")).isin("property", "getter", "setter", "attr_accessor", "attr_reader", "attr_writer")
    behave = (F.col("node_type") == "def") & (F.col("name") != "initialize")
    n = inside.groupBy("file", F.col("type_line").alias("line")).agg(F.sum(prop.cast("int")).alias("props"), F.sum(behave.cast("int")).alias("defs")).where("props >= 2 AND defs = 0")
    return _class_finding(classes.join(n, ["file", "line"]), "DataClass", "Low", F.col("props"))


def lcom4(method_fields: DataFrame) -> DataFrame:
    """(class, lcom4): components of methods that share a field, less one, from (class, method, field) (G-25)."""
    links = method_fields.select("class", F.concat(F.lit("m:"), "method").alias("a"), F.concat(F.lit("f:"), "field").alias("b"))
    roots = components(links, "class").where("node LIKE 'm:%'")
    return roots.groupBy("class").agg((F.count_distinct("label") - 1).alias("lcom4"))


def god_class(method_fields: DataFrame, cohesion: int = 2, methods: int = 20) -> DataFrame:
    n = method_fields.groupBy("class").agg(F.count_distinct("method").alias("methods"))
    return lcom4(method_fields).join(n, "class").where(f"lcom4 > {cohesion} AND methods > {methods}")


def tree_first(tree: DataFrame, flat: DataFrame) -> DataFrame:
    """Findings of syntax trees, and those of node rows for rules of which no tree has one anywhere (J-10)."""
    known = tree.select("rule").distinct()  # as many rows as there are rules
    return tree.unionByName(flat.join(F.broadcast(known), "rule", "left_anti"))


def all_smells(nodes: DataFrame) -> DataFrame:
    """Every node-table detector, one row for each (rule, file, line). Scopes and classes are worked out once."""
    nodes = durable(scoped(nodes))
    classes = durable(class_table(nodes))
    found = [
        high_complexity(nodes), long_method(nodes), spaghetti(nodes), long_parameter_list(nodes), deep_nesting(nodes), god_object(nodes), complex_conditional(nodes), message_chain(nodes),
        flag_argument(nodes), complex_match(nodes), dead_code(nodes), shotgun_surgery(nodes), hub_like_module(nodes), feature_envy(nodes), data_clumps(nodes), dry_violation(nodes),
        orphaned_spawn(nodes), muted_pack(nodes), dead_letter(nodes), lazy_class(classes), large_class(classes), blob(classes), base_class_should_be_abstract(classes),
        speculative_generality(classes), deep_inheritance(classes), tradition_breaker(classes), refused_bequest(classes, nodes), knows_derived(classes, nodes), parallel_inheritance(classes),
        anti_singleton(nodes), data_class(nodes, classes),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("rule", "file", "line").agg(F.min(F.struct("subject", "severity", "value")).alias("m")).select("rule", "m.severity", "file", "line", "m.subject", "m.value")
