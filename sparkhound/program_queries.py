"""Registered queries over a second fixture: line items as programs with classes, checks, sanitisers and string methods.

An order number's remainder is a file; a part number's remainder decides what a row is. Every detector below runs with the
limits it has in production.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions import words as W
from .operators import matching, reach, scopes, smells, taint
from .plans.fixpoint import durable
from .sources import project
from .sources.default_rules import default_sinks
from .sources.rules import sink_table
from .sources.xml_trees import xml_trees

FILES, KINDS = 97, 61
#: (kind, name, argument type, argument) by the remainder of the part number; {k} is the supplier, {q} the quantity, {v} the part.
PLAIN = ("", "", "")


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows; consecutive rows are one line apart and nine lines apart in turn."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m, k, q, v = F.col("l_partkey") % KINDS, F.col("l_suppkey").cast("long"), F.col("l_quantity").cast("long"), F.col("l_partkey").cast("long")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    file = text("f", F.col("l_orderkey") % FILES)
    n = F.row_number().over(Window.partitionBy("file").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    kind = (
        F.when(m == 0, "class").when(m <= 10, "def").when(m <= 16, "control").when(m <= 22, "assign").when(m <= 25, "terminator").when(m == 34, "module").when(m == 35, "guard").when(m <= 44, "call").when(m <= 56, "assign").otherwise("call")
    )
    name = (
        F.when(m == 0, text("C", k % 40)).when(m == 1, "initialize").when(m <= 10, text("m", k % 30))
        .when(m <= 13, F.concat(F.lit("if a && b"), F.when(q % 2 == 0, " || c && d").otherwise(""))).when(m == 14, "while x").when(m <= 16, "case")
        .when(m == 17, "@@count").when(m == 18, "@@instance").when(m <= 20, "@name").when(m <= 22, text("w", v % 30)).when(m <= 25, "return")
        .when(m <= 28, "property").when(m == 29, "a.b.c.d.e").when(m == 30, "a.b.c.d").when(m == 31, "spawn").when(m == 32, "rescue").when(m == 33, "require_admin")
        .when(m == 34, text("M", k % 7)).when(m == 35, "guard").when(m == 36, F.concat(text("w", v % 30), F.lit(".valid?"))).when(m <= 40, "File.read").when(m == 41, "redirect_to").when(m <= 44, text("obj", k % 9))
        .when(m <= 56, text("w", v % 30)).otherwise(text("m", k % 30))
    )
    var, call, literal = F.lit("var"), F.lit("call"), F.lit("literal")
    arg = lambda t, x: F.array(F.struct(t.alias("arg_type"), x.cast("string").alias("value"), F.lit("").alias("field")))
    other = text("w", (v * 7 + k) % 30)
    params = F.transform(F.sequence(F.lit(1), (q % 10 + 1).cast("int")), lambda i: F.struct(var.alias("arg_type"), F.when((i == 1) & (k % 9 == 0), "dry_run").when((i == 2) & (k % 4 == 0), "use_cache").otherwise(F.concat(F.lit("p"), i.cast("string"))).alias("value"), F.lit("").alias("field")))
    args = (
        F.when(m == 0, arg(literal, F.lit("x"))).when(m <= 10, params).when(m.isin(15, 16), arg(literal, q % 14)).when(m <= 14, arg(var, other)).when(m <= 25, arg(literal, F.lit("1")))
        .when(m <= 34, arg(literal, F.lit("x"))).when(m <= 44, arg(var, other))
        .when(m == 45, arg(call, F.lit("params.get"))).when(m == 46, arg(call, F.lit("check_ssrf"))).when(m <= 48, arg(call, F.concat(other, F.lit(".strip"))))
        .when(m == 49, F.concat(arg(call, F.lit("URI.parse")), arg(var, other))).when(m == 50, arg(call, F.concat(other, F.lit(".host")))).when(m == 51, arg(call, text("m", k % 30))).when(m <= 56, arg(var, other))
        .otherwise(arg(var, other))
    )
    meta = F.when((m == 0) & (k % 40 >= 3), F.map_from_arrays(F.array(F.lit("parent"), F.lit("abstract")), F.array(text("C", F.floor(k % 40 / 3)), (k % 4 == 0).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    rows = li.select(file.alias("file"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", kind.alias("node_type"), name.alias("name"), args.alias("args"), meta.alias("metadata")).withColumn("ord", n.cast("bigint"))
    line = (F.col("ord") * 5 - F.when(F.col("ord") % 2 == 0, 4).otherwise(0)).cast("int")
    return rows.select("file", "ord", line.alias("line"), "node_type", "name", "args", F.lit(False).alias("taint"), F.lit("sample").alias("language"), "metadata")


PROGRAM = f"""
items AS (SELECT concat('f', l_orderkey % {FILES}) AS file, CAST(row_number() OVER (PARTITION BY l_orderkey % {FILES} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS ord,
    CAST(l_partkey % {KINDS} AS INTEGER) AS m, CAST(l_suppkey AS BIGINT) AS k, CAST(l_quantity AS BIGINT) AS q, CAST(l_partkey AS BIGINT) AS v FROM lineitem),
prog AS (
    SELECT file, ord, CAST(ord * 5 - CASE WHEN ord % 2 = 0 THEN 4 ELSE 0 END AS INTEGER) AS line, m, k, q,
        CASE WHEN m = 0 THEN 'class' WHEN m <= 10 THEN 'def' WHEN m <= 16 THEN 'control' WHEN m <= 22 THEN 'assign' WHEN m <= 25 THEN 'terminator' WHEN m = 34 THEN 'module' WHEN m = 35 THEN 'guard'
            WHEN m <= 44 THEN 'call' WHEN m <= 56 THEN 'assign' ELSE 'call' END AS kind,
        CASE WHEN m = 0 THEN concat('C', k % 40) WHEN m = 1 THEN 'initialize' WHEN m <= 10 THEN concat('m', k % 30) WHEN m <= 13 THEN concat('if a && b', CASE WHEN q % 2 = 0 THEN ' || c && d' ELSE '' END)
            WHEN m = 14 THEN 'while x' WHEN m <= 16 THEN 'case' WHEN m = 17 THEN '@@count' WHEN m = 18 THEN '@@instance' WHEN m <= 20 THEN '@name' WHEN m <= 22 THEN concat('w', v % 30) WHEN m <= 25 THEN 'return'
            WHEN m <= 28 THEN 'property' WHEN m = 29 THEN 'a.b.c.d.e' WHEN m = 30 THEN 'a.b.c.d' WHEN m = 31 THEN 'spawn' WHEN m = 32 THEN 'rescue' WHEN m = 33 THEN 'require_admin' WHEN m = 34 THEN concat('M', k % 7)
            WHEN m = 35 THEN 'guard' WHEN m = 36 THEN concat('w', v % 30, '.valid?') WHEN m <= 40 THEN 'File.read' WHEN m = 41 THEN 'redirect_to' WHEN m <= 44 THEN concat('obj', k % 9) WHEN m <= 56 THEN concat('w', v % 30) ELSE concat('m', k % 30) END AS name,
        concat('w', (v * 7 + k) % 30) AS other,
        CASE WHEN m = 0 AND k % 40 >= 3 THEN concat('C', (k % 40) // 3) END AS parent, (m = 0 AND k % 40 >= 3 AND k % 4 = 0) AS is_abstract
    FROM items),
inside AS (
    SELECT *, last_value(CASE WHEN kind = 'def' THEN line END IGNORE NULLS) OVER w AS scope_line, last_value(CASE WHEN kind = 'def' THEN name END IGNORE NULLS) OVER w AS scope_name,
        last_value(CASE WHEN kind IN ('class', 'module') THEN line END IGNORE NULLS) OVER w AS type_line, last_value(CASE WHEN kind IN ('class', 'module') THEN name END IGNORE NULLS) OVER w AS type_name,
        last_value(CASE WHEN kind = 'class' THEN name END IGNORE NULLS) OVER w AS class_name
    FROM prog WINDOW w AS (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
classes AS (
    SELECT c.file, c.line, c.ord, c.name, c.parent, c.is_abstract, coalesce(c.next_line - 1, l.last_line) - c.line AS loc, coalesce(d.n, 0) AS n_methods, coalesce(d.methods, []) AS methods
    FROM (SELECT * FROM (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY ord) AS next_line FROM prog WHERE kind IN ('class', 'module')) WHERE kind = 'class') c
    JOIN (SELECT file, max(line) AS last_line FROM prog GROUP BY file) l USING (file)
    LEFT JOIN (SELECT file, type_line AS line, count(DISTINCT name) AS n, list(DISTINCT name) AS methods FROM inside WHERE kind = 'def' AND type_line IS NOT NULL GROUP BY ALL) d ON d.file = c.file AND d.line = c.line)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{PROGRAM}{oracle}"
        return f

    return add


def _rows(rule: str, severity: str, subject: str, value: str, source: str, line: str = "line") -> str:
    return f" SELECT '{rule}' AS rule, {severity} AS severity, file, CAST({line} AS INTEGER) AS line, {subject} AS subject, CAST({value} AS BIGINT) AS value FROM {source}"


def _grade(value: str, low: int, high: int) -> str:
    return f"CASE WHEN {value} >= {high} THEN 'High' ELSE 'Medium' END"


@query(_rows("GodObject", "'High'", "coalesce(type_name, file)", "count(*)", "inside WHERE kind = 'def' GROUP BY file, coalesce(type_name, file) HAVING count(*) >= 20", "min(line)"))
def god_object(spark, sf_dir):
    return smells.god_object(program(spark, sf_dir))


@query(_rows("LongParameterList", _grade("q % 10 + 1", 5, 8), "name", "q % 10 + 1", "prog WHERE kind = 'def' AND name <> 'initialize' AND q % 10 + 1 >= 5"))
def long_parameter_list(spark, sf_dir):
    return smells.long_parameter_list(program(spark, sf_dir))


@query(_rows("ComplexConditional", "'Medium'", "name", "3", "prog WHERE m BETWEEN 11 AND 13 AND q % 2 = 0"))
def complex_conditional(spark, sf_dir):
    return smells.complex_conditional(program(spark, sf_dir))


@query(_rows("MessageChain", "'Medium'", "name", "5", "prog WHERE m = 29"))
def message_chain(spark, sf_dir):
    return smells.message_chain(program(spark, sf_dir))


@query(
    _rows("FlagArgument", "'Low'", "'dry_run'", "1", "prog WHERE kind = 'def' AND k % 9 = 0")
    + " UNION ALL"
    + _rows("FlagArgument", "'Low'", "'use_cache'", "1", "prog WHERE kind = 'def' AND k % 4 = 0 AND q % 10 >= 1")
)
def flag_argument(spark, sf_dir):
    return smells.flag_argument(program(spark, sf_dir))


@query(_rows("ComplexMatch", _grade("q % 14", 5, 10), "name", "q % 14", "prog WHERE m IN (15, 16) AND q % 14 >= 5"))
def complex_match(spark, sf_dir):
    return smells.complex_match(program(spark, sf_dir))


@query(
    """, around AS (SELECT *, lag(kind) OVER w AS p_kind, lag(line) OVER w AS p_line,
        max(CASE WHEN kind = 'control' THEN line END) OVER (PARTITION BY file ORDER BY line RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS open FROM prog WINDOW w AS (PARTITION BY file ORDER BY ord))"""
    + _rows("DeadCode", "'Medium'", "name", "1", "around WHERE p_kind = 'terminator' AND kind NOT IN ('def', 'class', 'module', 'enum', 'control', 'terminator') AND line > p_line AND (open IS NULL OR open < p_line - 2)")
)
def dead_code(spark, sf_dir):
    return smells.dead_code(program(spark, sf_dir))


@query(
    _rows(
        "OrphanedSpawn", "'Medium'", "scope_name", "1",
        "inside s WHERE name = 'spawn' AND scope_line IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inside r WHERE r.file = s.file AND r.scope_line = s.scope_line AND r.name = 'rescue')",
    )
)
def orphaned_spawn(spark, sf_dir):
    return smells.orphaned_spawn(program(spark, sf_dir))


@query(_rows("AntiSingleton", "'Medium'", "concat(class_name, '.@@count')", "1", "inside WHERE name = '@@count' AND class_name IS NOT NULL"))
def anti_singleton(spark, sf_dir):
    return smells.anti_singleton(program(spark, sf_dir))


@query(" SELECT name, file, line, loc, n_methods, parent, is_abstract FROM classes")
def class_sizes(spark, sf_dir):
    return smells.class_table(program(spark, sf_dir)).select("name", "file", "line", "loc", F.col("n_methods").cast("bigint").alias("n_methods"), "parent", "is_abstract")


@query(_rows("LazyClass", "'Low'", "name", "n_methods", "classes WHERE n_methods BETWEEN 1 AND 2 AND NOT is_abstract"))
def lazy_class(spark, sf_dir):
    return smells.lazy_class(smells.class_table(program(spark, sf_dir)))


@query(_rows("LargeClass", _grade("loc", 200, 500), "name", "loc", "classes WHERE loc >= 200"))
def large_class(spark, sf_dir):
    return smells.large_class(smells.class_table(program(spark, sf_dir)))


@query(_rows("Blob", "CASE WHEN n_methods >= 25 AND loc >= 300 THEN 'High' ELSE 'Medium' END", "name", "n_methods", "classes WHERE n_methods >= 15 AND loc >= 200"))
def blob_class(spark, sf_dir):
    return smells.blob(smells.class_table(program(spark, sf_dir)))


@query(
    """, n AS (SELECT file, type_line AS line, count(*) FILTER (name = 'property') AS props, count(*) FILTER (kind = 'def' AND name <> 'initialize') AS defs FROM inside WHERE type_line IS NOT NULL GROUP BY ALL)"""
    + _rows("DataClass", "'Low'", "name", "props", "classes JOIN n USING (file, line) WHERE props >= 2 AND defs = 0")
)
def data_class(spark, sf_dir):
    n = program(spark, sf_dir)
    return smells.data_class(n, smells.class_table(n))


ONE = """, one AS (SELECT * FROM classes QUALIFY row_number() OVER (PARTITION BY name ORDER BY file DESC, ord DESC) = 1),
    up AS (SELECT name, parent AS ancestor FROM one WHERE parent IS NOT NULL UNION SELECT u.name, o.parent FROM up u JOIN one o ON o.name = u.ancestor AND o.parent IS NOT NULL)"""


@query(
    ONE
    + """, methods AS (SELECT name AS ancestor, unnest(methods) AS method FROM one WHERE NOT is_abstract),
    own AS (SELECT name, file, line AS type_line, unnest(methods) AS method FROM classes),
    both_ AS (SELECT DISTINCT o.name, o.file, o.type_line, o.method FROM own o JOIN up USING (name) JOIN methods USING (ancestor, method) WHERE o.method <> 'initialize'),
    defs AS (SELECT file, type_line, name AS method, line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY ord) - line, 1) AS size FROM inside WHERE kind = 'def')"""
    + _rows("RefusedParentBequest", "'Low'", "concat(name, '.', method)", "size", "both_ JOIN defs USING (file, type_line, method) WHERE size <= 10"),
    recursive=True,
)
def refused_bequest(spark, sf_dir):
    n = program(spark, sf_dir)
    return smells.refused_bequest(smells.class_table(n), n)


@query(" SELECT name, file, line, CASE WHEN starts_with(name, 'm') THEN 'custom' END AS kind FROM prog WHERE kind = 'def' AND starts_with(name, 'm1')")
def custom_entries(spark, sf_dir):
    return reach.entry_points(program(spark, sf_dir), ["m1"])


# -- taint with sanitisers, string methods, URI fields, aliases, returns, guards and path checks

#: m 45: source; 46: sanitiser; 47, 48: string method; 49: URI fields; 50: other method; 51: call of a function; 52 to 56: alias
FLOW = """,
clean AS (SELECT DISTINCT file, name FROM prog WHERE m = 46),
calls AS (SELECT file, line, arg_max(other, ord) AS other FROM prog WHERE kind = 'call' AND m >= 35 AND name NOT LIKE '%valid?' GROUP BY ALL),
edges AS (
    SELECT DISTINCT * FROM (
        SELECT file, other AS src, NULL AS src_field, name AS dst, NULL AS dst_field FROM prog WHERE m BETWEEN 52 AND 56 OR m = 49
        UNION ALL SELECT file, other, '', name, '' FROM prog WHERE m IN (47, 48)
        UNION ALL SELECT file, other, '', name, unnest(['host', 'request_target', 'path', 'query', 'full_path', 'scheme']) FROM prog WHERE m = 49
    ) e WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.file = e.file AND c.name = e.dst)),
tainted(file, var, field) AS (
    SELECT DISTINCT file, name, '' FROM prog WHERE m = 45
    UNION
    SELECT e.file, e.dst, coalesce(e.dst_field, t.field) FROM tainted t JOIN edges e ON e.file = t.file AND e.src = t.var WHERE e.src_field IS NULL OR e.src_field = t.field)"""


def _tainted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = durable(program(spark, sf_dir))
    return n, durable(taint.propagate(taint.seeds(n), durable(taint.flows(n))))


@query(FLOW + " SELECT file, var, field FROM tainted", recursive=True)
def tainted_fields(spark, sf_dir):
    """Sources, sanitisers, string methods, URI fields and aliases in one closure."""
    return _tainted(spark, sf_dir)[1].select("file", "var", "field")


@query(
    FLOW
    + """, inner_ AS (SELECT i.file, i.scope_name AS func_name FROM inside i JOIN tainted t ON t.file = i.file AND t.var = i.name AND t.field = '' WHERE i.kind = 'assign' AND i.scope_line IS NOT NULL)
    SELECT DISTINCT p.file, p.name AS var FROM prog p JOIN inner_ r ON r.file = p.file AND r.func_name = concat('m', p.k % 30) WHERE p.m = 51""",
    recursive=True,
)
def tainted_by_returns(spark, sf_dir):
    """Assignments from functions of the same file whose body holds a tainted assignment."""
    n, known = _tainted(spark, sf_dir)
    return taint.from_returns(n, taint.tainted_returns(n, known)).select("file", "var")


RULES = """
rule "PathTraversal" severity="High" {
    sinks { sink "File.read" arg=0 match="exact" }
    message "{sink} opens {tainted_vars}"
}
rule "OpenRedirect" severity="Medium" {
    sinks { sink "redirect_to" arg=0 }
    message "{sink} goes to {tainted_vars}"
}
"""
HITS = """,
hits AS (
    SELECT CASE WHEN p.name = 'File.read' THEN 'PathTraversal' ELSE 'OpenRedirect' END AS rule, p.file, p.line, p.ord, p.other
    FROM prog p WHERE p.m BETWEEN 37 AND 41 AND EXISTS (SELECT 1 FROM tainted t WHERE t.file = p.file AND t.var = p.other AND t.field = ''))"""


@query(
    FLOW
    + HITS
    + """, guards AS (SELECT file, other AS var, min(line) AS guard_line FROM prog WHERE kind = 'guard' GROUP BY ALL)
    SELECT h.rule, h.file, h.line FROM hits h LEFT JOIN guards g ON g.file = h.file AND g.var = h.other WHERE g.guard_line IS NULL OR h.line < g.guard_line""",
    recursive=True,
)
def guarded_sinks(spark, sf_dir):
    """Production rules behind guards: those of guard rows, from their line on."""
    n, known = _tainted(spark, sf_dir)
    return matching.findings(n, sink_table(spark, RULES), known, taint.guard_lines(n)).select("rule", "file", "line")


@query(
    FLOW
    + HITS
    + """, defs AS (SELECT file, line, lead(line) OVER (PARTITION BY file ORDER BY line) AS next_line FROM prog WHERE kind = 'def'),
    checks AS (
        SELECT i.file, CASE WHEN i.m = 33 THEN 'auth' ELSE 'check' END AS kind, CASE WHEN i.m = 36 THEN replace(i.name, '.valid?', '') END AS var, i.line AS from_line,
            CASE WHEN i.m = 33 THEN coalesce(d.next_line, i.line + 200) ELSE i.line + 50 END AS to_line
        FROM inside i JOIN defs d ON d.file = i.file AND d.line = i.scope_line WHERE i.m IN (33, 36))
    SELECT rule, file, line FROM hits h WHERE NOT EXISTS (SELECT 1 FROM checks c WHERE c.file = h.file AND c.from_line <= h.line AND h.line < c.to_line AND (c.kind = 'auth' OR c.var = h.other))""",
    recursive=True,
)
def findings_outside_checks(spark, sf_dir):
    """Findings that no authentication and no check of their variable covers."""
    n, known = _tainted(spark, sf_dir)
    found = matching.findings(n, sink_table(spark, RULES), known)
    return matching.outside_scopes(found, matching.validation_scopes(n)).select("rule", "file", "line")


@query(
    FLOW
    + """, rule(name, rule, severity) AS (VALUES ('File.read', 'PathTraversal', 'High'), ('File.read', 'UnboundedRead', 'Low'), ('File.read', 'TOCTOU', 'Medium'), ('redirect_to', 'OpenRedirect', 'Medium'))
    SELECT DISTINCT r.rule, r.severity, p.file, p.line FROM prog p JOIN rule r USING (name) WHERE p.kind = 'call' AND EXISTS (SELECT 1 FROM tainted t WHERE t.file = p.file AND t.var = p.other AND t.field = '')""",
    recursive=True,
)
def default_rule_findings(spark, sf_dir):
    """All rules that come with the library, over all calls."""
    n, known = _tainted(spark, sf_dir)
    return matching.findings(n, default_sinks(spark), known).select("rule", "severity", "file", "line")


@query(
    ", e AS (SELECT scope_name AS caller, name AS callee FROM inside WHERE kind = 'call' AND scope_name IS NOT NULL AND name IN (SELECT name FROM prog WHERE kind = 'def') GROUP BY ALL)"
    " SELECT callee AS name, count(*) AS callers FROM e GROUP BY callee"
)
def callers_by_function(spark, sf_dir):
    return reach.call_edges(program(spark, sf_dir)).groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("callers"))


@query(
    _rows("LongParameterList", _grade("q % 10 + 1", 5, 8), "name", "q % 10 + 1", "prog WHERE kind = 'def' AND name <> 'initialize' AND q % 10 + 1 >= 5 AND file = 'f1'")
    + " UNION ALL"
    + _rows("MessageChain", "'Medium'", "name", "5", "prog WHERE m = 29")
)
def smells_of_trees_first(spark, sf_dir):
    """One file's findings stand for those of its trees; of their rules no other file's flat finding stays."""
    n = program(spark, sf_dir)
    flat = smells.long_parameter_list(n).unionByName(smells.message_chain(n))
    return smells.tree_first(smells.long_parameter_list(n.where("file = 'f1'")), flat)


@query(
    """, files AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'crystal' WHEN 1 THEN 'elixir' WHEN 2 THEN 'typescript' END AS lang FROM part)
    SELECT lang, count(*) AS n FROM files WHERE lang IS NOT NULL GROUP BY lang"""
)
def language_counts(spark, sf_dir):
    ends = F.element_at(F.array(F.lit("cr"), F.lit("exs"), F.lit("tsx"), F.lit("txt")), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select(project.language(F.concat(F.lit("src/x"), F.col("p_partkey").cast("string"), F.lit("."), ends)).alias("lang")).where("lang IS NOT NULL")
    return project.language_counts(files)


@query(
    """, t AS (SELECT n_regionkey AS file, 'nation' AS tag, 1 AS depth, n_name AS text, n_nationkey + 1 AS line FROM nation
        UNION ALL SELECT r_regionkey, 'region', 0, '', 1 FROM region)
    SELECT CAST(file AS VARCHAR) AS file, tag, depth, text, CAST(line AS INTEGER) AS line FROM t"""
)
def xml_nodes(spark, sf_dir):
    """Regions as XML documents with their nations as children, read back as rows."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    child = F.concat(F.lit('<nation srow="'), F.col("n_nationkey").cast("string"), F.lit('">'), F.col("n_name"), F.lit("</nation>"))
    inner = nation.groupBy(F.col("n_regionkey").alias("file")).agg(F.array_join(F.sort_array(F.collect_list(child)), "").alias("inner"))
    docs = region.select(F.col("r_regionkey").alias("file")).join(inner, "file", "left").select("file", F.concat(F.lit('<region srow="0">'), F.coalesce("inner", F.lit("")), F.lit("</region>")).alias("content"))
    return xml_trees(docs).select("file", "tag", "depth", "text", "line")
