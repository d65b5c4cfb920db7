"""Registered queries over a fourth fixture: an order is a file of one language, its line items are rows: imports, functions, assignments and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import imports, matching, statics, taint
from .plans.fixpoint import durable
from .sources.rules import sink_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KINDS = 9
#: By the remainder of the part number: 0 import, 1 function, 2 source, 3 and 4 a variable, 5 a function's result, 6 a literal, 7 a file is read, 8 a statement runs.


def _path(key):
    return F.concat(F.lit("src/m"), (key % 3).cast("string"), F.when(key % 4 == 0, F.concat(F.lit("/o"), key.cast("string"), F.lit("/index.cr"))).otherwise(F.concat(F.lit("/o"), key.cast("string"), F.lit(".cr"))))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows; an import names one of the ten orders around its own, which may be there or not."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o, v, k = F.col("l_orderkey").cast("long"), F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")
    m = v % KINDS
    to = F.floor(o / 10) * 10 + k % 10
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    # a file in a folder of its own (index) is one level further down
    up = F.concat(F.when(o % 4 == 0, "./../..").otherwise("./.."), F.lit("/m"), (to % 3).cast("string"), F.lit("/./o"), to.cast("string"))
    kind = F.when(m == 0, "import").when(m == 1, "def").when(m <= 6, "assign").otherwise("call")
    name = F.when(m == 0, "require").when(m == 1, text("fn", k % 4)).when(m <= 6, text("v", v % 5)).when(m == 7, "File.read").otherwise("db.query")
    arg = lambda t, x: F.array(F.struct(F.lit(t).alias("arg_type"), x.cast("string").alias("value"), F.lit("").alias("field")))
    other = text("v", k % 5)
    args = (
        F.when(m == 0, arg("literal", up)).when(m == 1, arg("var", text("p", k % 3))).when(m == 2, arg("call", F.lit("params.get"))).when(m <= 4, arg("var", other))
        .when(m == 5, arg("call", text("fn", k % 4))).when(m == 6, arg("literal", F.lit("x"))).otherwise(arg("var", other))
    )
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return li.select(
        _path(o).alias("file"), ord_.cast("bigint").alias("ord"), ord_.cast("int").alias("line"), kind.alias("node_type"), name.alias("name"), args.alias("args"), F.lit(False).alias("taint"),
        F.lit("crystal").alias("language"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


MODULES = f"""
m0 AS (SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_partkey AS BIGINT) AS v, CAST(l_suppkey AS BIGINT) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line FROM lineitem),
rows_ AS (
    SELECT concat('src/m', o % 3, CASE WHEN o % 4 = 0 THEN concat('/o', o, '/index.cr') ELSE concat('/o', o, '.cr') END) AS file, o, (o // 10) * 10 + k % 10 AS target, CAST(line AS INTEGER) AS line, CAST(v % {KINDS} AS INTEGER) AS m,
        concat('v', v % 5) AS var, concat('v', k % 5) AS other, concat('fn', k % 4) AS fn, concat('p', k % 3) AS param FROM m0),
files AS (SELECT DISTINCT o, file FROM rows_),
direct AS (SELECT DISTINCT r.file, f.file AS imported_file FROM rows_ r JOIN files f ON f.o = r.target WHERE r.m = 0),
reach AS (SELECT file, imported_file FROM direct UNION SELECT r.file, d.imported_file FROM reach r JOIN direct d ON d.file = r.imported_file),
scoped AS (SELECT *, last_value(CASE WHEN m = 1 THEN fn END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM rows_),
seen_from AS (SELECT file, imported_file FROM reach WHERE file <> imported_file UNION SELECT file, file FROM files),
edges AS (
    SELECT DISTINCT 'v' AS from_kind, file AS from_file, other AS from_name, 'v' AS kind, file, var AS name FROM rows_ WHERE m IN (3, 4)
    UNION SELECT DISTINCT 'v', file, var, 'f', file, scope FROM scoped WHERE m BETWEEN 2 AND 6 AND scope IS NOT NULL
    UNION SELECT DISTINCT 'f', s.imported_file, r.fn, 'v', r.file, r.var FROM rows_ r JOIN seen_from s USING (file) WHERE r.m = 5),
facts AS (SELECT DISTINCT 'v' AS kind, file, var AS name FROM rows_ WHERE m = 2 UNION SELECT e.kind, e.file, e.name FROM facts f JOIN edges e ON e.from_kind = f.kind AND e.from_file = f.file AND e.from_name = f.name),
dynamic AS (
    SELECT file, var FROM rows_ WHERE m IN (2, 5) UNION SELECT file, param FROM rows_ WHERE m = 1
    UNION SELECT r.file, r.other FROM rows_ r WHERE r.m IN (3, 4) AND NOT EXISTS (SELECT 1 FROM rows_ d WHERE d.file = r.file AND d.var = r.other AND d.m BETWEEN 2 AND 6)
    UNION SELECT r.file, r.var FROM dynamic d JOIN rows_ r ON r.file = d.file AND r.other = d.var AND r.m IN (3, 4)),
static AS (SELECT DISTINCT file, var FROM rows_ WHERE m BETWEEN 2 AND 6 EXCEPT SELECT file, var FROM dynamic)"""


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH RECURSIVE {MODULES}{oracle}"
        return f

    return add


@query(" SELECT file, imported_file FROM direct")
def resolved_imports(spark, sf_dir):
    """Relative paths with dots and index files, resolved to the files that exist."""
    n = modules(spark, sf_dir)
    return imports.resolved_imports(n, n)


def _taint(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = durable(modules(spark, sf_dir))
    return n, taint.analyse(n, imports.reexported(imports.resolved_imports(n, n)))


@query(" SELECT file, name AS var FROM facts WHERE kind = 'v'")
def cross_file_taint(spark, sf_dir):
    """Taint through functions of imported files, and of what those import, to the end."""
    return _taint(spark, sf_dir)[1].select("file", "var").distinct()


@query(
    """, wide AS (SELECT from_kind, from_file, from_name, kind, file, name FROM edges
        UNION SELECT DISTINCT 'v', file, name, 'n', '', name FROM (SELECT file, var AS name FROM rows_ WHERE m BETWEEN 2 AND 6) UNION SELECT DISTINCT 'n', '', other, 'v', file, other FROM rows_ WHERE m IN (3, 4)
        UNION SELECT DISTINCT 'v', file, other, 'n', '', other FROM rows_ WHERE m IN (3, 4)),
    known AS (SELECT DISTINCT 'v' AS kind, file, var AS name FROM rows_ WHERE m = 2 UNION SELECT e.kind, e.file, e.name FROM known f JOIN wide e ON e.from_kind = f.kind AND e.from_file = f.file AND e.from_name = f.name)
    SELECT file, name AS var FROM known WHERE kind = 'v'"""
)
def same_name_taint(spark, sf_dir):
    """Taint that also crosses files by variables' names."""
    n = durable(modules(spark, sf_dir))
    return taint.analyse(n, imports.reexported(imports.resolved_imports(n, n)), by_name=True).select("file", "var").distinct()


@query(" SELECT file, var FROM static")
def static_variables(spark, sf_dir):
    return statics.static_variables(modules(spark, sf_dir))


RULES = """
rule "SQLInjection" severity="Critical" {
    sinks { sink "db.query" arg=0 }
    message "{sink} runs {tainted_vars}"
}
rule "PathTraversal" severity="High" {
    sinks { sink "File.read" arg=0 }
    message "{sink} opens {tainted_vars}"
}
"""


@query(
    """ SELECT CASE WHEN r.m = 7 THEN 'PathTraversal' ELSE 'SQLInjection' END AS rule, r.file, r.line FROM rows_ r
    WHERE r.m IN (7, 8) AND EXISTS (SELECT 1 FROM facts f WHERE f.kind = 'v' AND f.file = r.file AND f.name = r.other) AND NOT (r.m = 8 AND EXISTS (SELECT 1 FROM static s WHERE s.file = r.file AND s.var = r.other))"""
)
def module_findings(spark, sf_dir):
    """Sinks reached across files; statements that only static variables make up are bound by parameters."""
    n, known = _taint(spark, sf_dir)
    # findings look at calls several times; the closure behind their metadata runs once
    calls = durable(statics.with_parameterized(n).where("node_type = 'call'"))
    return matching.findings(calls, sink_table(spark, RULES), known).select("rule", "file", "line")


@query(" SELECT r.file, r.line FROM rows_ r JOIN static s ON s.file = r.file AND s.var = r.other WHERE r.m = 8")
def parameterized_calls(spark, sf_dir):
    """Database calls whose statement is static."""
    return statics.with_parameterized(modules(spark, sf_dir)).where("metadata['parameterized_query'] = 'true'").select("file", "line")
