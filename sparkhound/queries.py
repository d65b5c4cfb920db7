"""Registered queries over the fixture tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import module_queries, program_queries, tree_queries
from .functions import predicates as P
from .operators import cfg, changes, matching, reach, scopes, smells, taint, text_lint
from .plans.fixpoint import durable
from .sources.nodes import event_nodes
from .sources.rules import sink_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NODES = """
base AS (SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, event_type,
                CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
nodes AS (SELECT file, CAST(line AS INTEGER) AS line,
   CASE event_type WHEN 'signup' THEN 'def' WHEN 'click' THEN 'assign' WHEN 'error' THEN 'control' ELSE 'call' END AS node_type,
   CASE event_type WHEN 'click' THEN concat('v', CAST(k % 40 AS VARCHAR)) WHEN 'error' THEN 'if' ELSE concat('fn', CAST(k % 25 AS VARCHAR)) END AS name,
   concat('v', CAST(lag(k, 1, 0) OVER (PARTITION BY file ORDER BY line) % 40 AS VARCHAR)) AS arg_var,
   (event_type = 'click' AND k % 20 = 0) AS taint FROM base),
scoped AS (SELECT *, last_value(CASE WHEN node_type = 'def' THEN line END IGNORE NULLS) OVER w AS scope_line,
                  last_value(CASE WHEN node_type = 'def' THEN name END IGNORE NULLS) OVER w AS scope_name
           FROM nodes WINDOW w AS (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
TAINT = """,
closure AS (
    SELECT DISTINCT file, name AS var FROM nodes WHERE node_type = 'assign' AND taint
    UNION
    SELECT n.file, n.name FROM closure c JOIN nodes n ON n.file = c.file AND n.arg_var = c.var AND n.node_type = 'assign')"""


def query(oracle: str | None = None, nodes: bool = True, recursive: bool = False):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}{NODES}{oracle}") if nodes else oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_nodes(table(spark, sf_dir, "events"))


@query(" SELECT node_type, count(*) AS n, count(DISTINCT name) AS names FROM nodes GROUP BY node_type")
def node_mix(spark, sf_dir):
    return nodes_of(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query(" SELECT file, count(*) AS n, max(line) AS last_line FROM nodes GROUP BY file")
def nodes_per_file(spark, sf_dir):
    return nodes_of(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


@query(" SELECT file, name AS func_name, line AS start_line, CAST(coalesce(lead(line) OVER (PARTITION BY file ORDER BY line) - 1, 2147483647) AS INTEGER) AS end_line FROM nodes WHERE node_type = 'def'")
def function_scopes(spark, sf_dir):
    return scopes.function_scopes(nodes_of(spark, sf_dir))


BODY = " SELECT file, scope_name AS func_name, scope_line AS start_line, CAST(count(*) FILTER (node_type <> 'def') AS BIGINT) AS n_nodes FROM scoped WHERE scope_line IS NOT NULL GROUP BY ALL"


@query(BODY)
def body_sizes(spark, sf_dir):
    return scopes.body_sizes(nodes_of(spark, sf_dir))


@query(
    """ SELECT d.file, d.line, max(p.line) AS def_line FROM nodes d LEFT JOIN nodes p ON p.file = d.file AND p.node_type = 'def' AND p.line < d.line
    WHERE d.node_type = 'assign' GROUP BY d.file, d.line"""
)
def nearest_preceding_def(spark, sf_dir):
    return scopes.with_scope(nodes_of(spark, sf_dir), strict=True).where("node_type = 'assign'").select("file", "line", F.col("scope_line").alias("def_line"))


def _graded_sql(rule: str, low: int, high: int, value: str, rows: str) -> str:
    return f" SELECT '{rule}' AS rule, CASE WHEN {value} >= {high} THEN 'High' ELSE 'Medium' END AS severity, file, line, subject, CAST({value} AS BIGINT) AS value FROM ({rows}) WHERE {value} >= {low}"


_SIZES = "SELECT file, scope_line AS line, scope_name AS subject, count(*) FILTER (node_type <> 'def') AS n FROM scoped WHERE scope_line IS NOT NULL GROUP BY ALL"


@query(_graded_sql("LongMethod", 30, 50, "n", _SIZES))
def long_method(spark, sf_dir):
    return smells.long_method(nodes_of(spark, sf_dir))


@query(_graded_sql("SpaghettiCode", 60, 100, "n", _SIZES))
def spaghetti_code(spark, sf_dir):
    return smells.spaghetti(nodes_of(spark, sf_dir))


@query(
    _graded_sql(
        "HighComplexity", 4, 8, "n",
        "SELECT file, scope_line AS line, scope_name AS subject, count(*) FILTER (name = 'if') + 1 AS n FROM scoped WHERE scope_line IS NOT NULL AND node_type <> 'def' GROUP BY ALL",
    )
)
def high_complexity(spark, sf_dir):
    return smells.high_complexity(nodes_of(spark, sf_dir), smells.Limits(complexity=(4, 8)))


@query(
    _graded_sql(
        "DeepNesting", 5, 7, "n",
        "SELECT file, scope_line AS line, scope_name AS subject, count(*) AS n FROM scoped WHERE scope_line IS NOT NULL AND node_type = 'control' GROUP BY ALL",
    )
)
def deep_nesting(spark, sf_dir):
    return smells.deep_nesting(nodes_of(spark, sf_dir))


@query(_graded_sql("ShotgunSurgery", 5, 1073741824, "n", "SELECT file, name AS subject, count(*) AS n, min(line) AS line FROM nodes WHERE node_type = 'call' GROUP BY ALL"))
def shotgun_surgery(spark, sf_dir):
    return smells.shotgun_surgery(nodes_of(spark, sf_dir))


@query(_graded_sql("HubLikeModule", 12, 20, "n", "SELECT file, file AS subject, count(DISTINCT name) AS n, min(line) AS line FROM nodes WHERE node_type = 'call' GROUP BY file"))
def hub_like_module(spark, sf_dir):
    return smells.hub_like_module(nodes_of(spark, sf_dir))


@query(
    """, acc AS (SELECT file, scope_line, scope_name, name AS receiver, count(*) AS n FROM scoped WHERE node_type = 'call' AND scope_line IS NOT NULL GROUP BY ALL),
    best AS (SELECT file, scope_line, scope_name, sum(n) AS total, max(n) AS most, arg_min(receiver, (-n, receiver)) AS receiver FROM acc GROUP BY ALL)
    SELECT 'FeatureEnvy' AS rule, 'Medium' AS severity, file, scope_line AS line, concat(scope_name, ' -> ', receiver) AS subject, CAST(most AS BIGINT) AS value
    FROM best WHERE total >= 2 AND most / total >= 0.6"""
)
def feature_envy(spark, sf_dir):
    return smells.feature_envy(nodes_of(spark, sf_dir), least=2, share=0.6)


@query(
    """, f AS (SELECT file, line, list(node_type) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS frame FROM nodes),
    m AS (SELECT file, line, md5(array_to_string(frame, '|')) AS hash FROM f WHERE len(frame) = 5)
    SELECT hash, count(DISTINCT (file, line)) AS n, count(DISTINCT file) AS files, min((file, line))[1] AS file, min((file, line))[2] AS line FROM m
    GROUP BY hash HAVING count(DISTINCT (file, line)) >= 4 AND count(DISTINCT file) >= 2"""
)
def duplicate_windows(spark, sf_dir):
    return smells.duplicate_windows(nodes_of(spark, sf_dir), smells.Limits(window=5), F.col("node_type"))


@query(TAINT + " SELECT file, var FROM closure", recursive=True)
def taint_closure(spark, sf_dir):
    return taint.analyse(durable(nodes_of(spark, sf_dir))).where("field = ''").select("file", "var")


@query(TAINT + " SELECT n.file, n.line, n.name, n.arg_var AS var FROM nodes n JOIN closure c ON c.file = n.file AND c.var = n.arg_var WHERE n.node_type = 'call'", recursive=True)
def tainted_sinks(spark, sf_dir):
    n = durable(nodes_of(spark, sf_dir))
    return taint.sink_hits(n.where("node_type = 'call'"), taint.analyse(n)).select("file", "line", "name", "var")


#: Rules for the fixture, in the rule language that the loader reads.
RULES = """
rule "CommandInjection" severity="Critical" {
    sinks { sink "fn3" arg=0 match="exact" { fix "check({arg0})" } sink "fn4" match="exact" }
    message "{sink} gets {tainted_vars}"
}
rule "PathTraversal" severity="High" {
    sinks { sink "n1" arg=0 }
    message "path from {tainted_vars} in {sink}"
}
rule "AnyCall" severity="Low" {
    languages { exclude "other" }
    sinks { sink "$fn7" }
    conditions { requires_tainted_args false }
    message "call of {sink}"
}
rule "OtherLanguage" severity="High" {
    languages { include "other" }
    sinks { sink "fn" }
    message "never here"
}
"""
FOUND = (
    TAINT
    + """,
found AS (
    SELECT 'CommandInjection' AS rule, 'Critical' AS severity, n.file, n.line, concat(n.name, ' gets ', n.arg_var) AS message,
           CASE WHEN n.name = 'fn3' THEN concat('check(', n.arg_var, ')') ELSE '' END AS suggestion, n.name, n.arg_var
    FROM nodes n JOIN closure c ON c.file = n.file AND c.var = n.arg_var WHERE n.node_type = 'call' AND n.name IN ('fn3', 'fn4')
    UNION ALL
    SELECT 'PathTraversal', 'High', n.file, n.line, concat('path from ', n.arg_var, ' in ', n.name), '', n.name, n.arg_var
    FROM nodes n JOIN closure c ON c.file = n.file AND c.var = n.arg_var WHERE n.node_type = 'call' AND contains(n.name, 'n1')
    UNION ALL
    SELECT 'AnyCall', 'Low', n.file, n.line, concat('call of ', n.name), '', n.name, n.arg_var FROM nodes n WHERE n.node_type = 'call' AND n.name = 'fn7')"""
)


def _found(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = durable(nodes_of(spark, sf_dir))
    return n, matching.findings(n, sink_table(spark, RULES), taint.analyse(n))


@query(FOUND + " SELECT rule, severity, file, line, message, suggestion FROM found", recursive=True)
def rule_findings(spark, sf_dir):
    return _found(spark, sf_dir)[1].select("rule", "severity", "file", "line", "message", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


@query(FOUND + " SELECT CASE WHEN severity IN ('Critical', 'High') THEN 'Error' WHEN severity IN ('Medium', 'Low') THEN 'Warning' ELSE 'Info' END AS label, count(*) AS n FROM found GROUP BY 1", recursive=True)
def severity_summary(spark, sf_dir):
    return matching.summary(_found(spark, sf_dir)[1])


@query(
    FOUND
    + """, guards AS (SELECT file, arg_var AS var, min(line) AS guard_line FROM nodes WHERE node_type = 'control' GROUP BY ALL)
    SELECT f.rule, f.file, f.line FROM found f LEFT JOIN guards g ON g.file = f.file AND g.var = f.arg_var WHERE f.rule = 'AnyCall' OR g.guard_line IS NULL OR f.line < g.guard_line""",
    recursive=True,
)
def guarded_findings(spark, sf_dir):
    n = durable(nodes_of(spark, sf_dir))
    guards = taint.guard_lines(n.withColumn("node_type", F.when(F.col("node_type") == "control", "guard").otherwise(F.col("node_type"))))
    return matching.findings(n, sink_table(spark, RULES), taint.analyse(n), guards).select("rule", "file", "line")


@query(
    FOUND
    + """, checks AS (SELECT file, arg_var AS var, line AS from_line, line + 50 AS to_line FROM nodes WHERE node_type = 'control')
    SELECT rule, file, line FROM found f WHERE NOT (rule IN ('CommandInjection', 'PathTraversal') AND EXISTS (
        SELECT 1 FROM checks c WHERE c.file = f.file AND c.var = f.arg_var AND c.from_line <= f.line AND f.line < c.to_line))""",
    recursive=True,
)
def path_suppressed(spark, sf_dir):
    n, found = _found(spark, sf_dir)
    checks = n.where("node_type = 'control'").select("file", F.lit("check").alias("kind"), F.get("args.value", 0).alias("var"), F.col("line").alias("from_line"), (F.col("line") + 50).alias("to_line"))
    return matching.outside_scopes(found, checks).select("rule", "file", "line")


EDGES = """, edges AS (SELECT s.scope_name AS caller, s.name AS callee, min((s.file, s.line)) AS site FROM scoped s
    WHERE s.node_type = 'call' AND s.scope_name IS NOT NULL AND s.name IN (SELECT name FROM nodes WHERE node_type = 'def') GROUP BY 1, 2)"""


@query(EDGES + " SELECT caller, callee, site[1] AS file, site[2] AS line FROM edges")
def call_edges(spark, sf_dir):
    return reach.call_edges(nodes_of(spark, sf_dir))


@query(" SELECT name, file, line, 'custom' AS kind FROM nodes WHERE node_type = 'def' AND starts_with(name, 'fn2')")
def entry_points(spark, sf_dir):
    return reach.entry_points(nodes_of(spark, sf_dir), ["fn2"])


REACHED = (
    EDGES
    + """, walk AS (
    SELECT DISTINCT name, 0 AS hops FROM nodes WHERE node_type = 'def' AND name = 'fn2'
    UNION
    SELECT e.callee, w.hops + 1 FROM walk w JOIN edges e ON e.caller = w.name WHERE w.hops < 30),
    reached AS (SELECT name, min(hops) AS hops FROM walk GROUP BY name)"""
)


@query(REACHED + " SELECT name, hops FROM reached", recursive=True)
def reachable_functions(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    entries = reach.entry_points(n, ["fn2"]).where("name = 'fn2'")
    return reach.reachable(reach.call_edges(n), entries).select("name", "hops")


@query(REACHED + " SELECT name, CAST(hops + 1 AS INTEGER) AS path_length FROM reached", recursive=True)
def shortest_paths(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    found = reach.reachable(reach.call_edges(n), reach.entry_points(n, ["fn2"]).where("name = 'fn2'"))
    return reach.paths(found).select("name", F.size("path").alias("path_length"))


@query(
    REACHED
    + """, live AS (SELECT s.file, CASE WHEN r.name IS NOT NULL THEN 1 ELSE 0 END AS live FROM scoped s LEFT JOIN reached r ON r.name = s.scope_name
        WHERE s.node_type = 'call' AND s.name = 'fn7')
    SELECT file, CAST(sum(live) AS BIGINT) AS live, CAST(count(*) - sum(live) AS BIGINT) AS dormant, count(*) AS total FROM live GROUP BY file""",
    recursive=True,
)
def file_heatmap(spark, sf_dir):
    n = durable(nodes_of(spark, sf_dir))
    found = matching.findings(n, sink_table(spark, RULES).where("rule = 'AnyCall'"), taint.seeds(n))
    reached = reach.reachable(reach.call_edges(n), reach.entry_points(n, ["fn2"]).where("name = 'fn2'"))
    return reach.heatmap(reach.tagged(found, n, reached)).select("file", "live", "dormant", "total")


# -- tables beside events


def _clump_nodes(spark, sf_dir) -> DataFrame:
    """Orders as definitions whose parameters are their suppliers."""
    li = table(spark, sf_dir, "lineitem")
    arg = F.struct(F.lit("var").alias("arg_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("value"), F.lit("").alias("field"))
    return li.groupBy("l_orderkey").agg(F.collect_list(arg).alias("args")).select(
        (F.col("l_orderkey") % 100).cast("string").alias("file"), (F.col("l_orderkey")).cast("int").alias("line"), F.lit("def").alias("node_type"), "args"
    )


@query(
    """WITH d AS (SELECT DISTINCT l_orderkey AS o, concat('s', CAST(l_suppkey AS VARCHAR)) AS s FROM lineitem),
    p AS (SELECT x.o, x.s AS a, y.s AS b FROM d x JOIN d y ON x.o = y.o AND x.s < y.s)
    SELECT concat(a, ',', b) AS subject, count(*) AS value FROM p GROUP BY a, b HAVING count(*) >= 3 AND count(DISTINCT CAST(o % 100 AS VARCHAR)) >= 2""",
    nodes=False,
)
def param_pair_clumps(spark, sf_dir):
    return smells.data_clumps(_clump_nodes(spark, sf_dir)).select("subject", "value")


@query(
    "SELECT l_orderkey AS class, count(DISTINCT l_suppkey % 3) - 1 AS lcom4 FROM lineitem GROUP BY l_orderkey",
    nodes=False,
)
def lcom4(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("class"), F.concat_ws("-", "l_linenumber", "l_suppkey").alias("method"), (F.col("l_suppkey") % 3).cast("string").alias("field"))
    return smells.lcom4(li)


def _classes(spark, sf_dir) -> DataFrame:
    """Parts as classes in a ternary tree."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("name"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.when(F.col("p_partkey") >= 3, F.floor(F.col("p_partkey") / 3).cast("string")).alias("parent"),
        (F.col("p_size") % 2 == 0).alias("is_abstract"), F.lit(1).alias("n_methods"), F.lit(1).alias("loc"),
    )


@query(
    """WITH RECURSIVE up AS (SELECT p_partkey AS name, p_partkey // 3 AS ancestor, 1 AS depth FROM part WHERE p_partkey >= 3
        UNION ALL SELECT name, ancestor // 3, depth + 1 FROM up WHERE ancestor >= 3)
    SELECT CAST(name AS VARCHAR) AS name, CAST(ancestor AS VARCHAR) AS ancestor, depth FROM up""",
    nodes=False,
)
def class_ancestors(spark, sf_dir):
    return reach.ancestors(_classes(spark, sf_dir))


@query(
    """WITH c AS (SELECT p_partkey // 3 AS p, count(*) AS n FROM part WHERE p_partkey >= 3 GROUP BY 1)
    SELECT CAST(p_partkey AS VARCHAR) AS subject, CAST(n AS BIGINT) AS value FROM part JOIN c ON p = p_partkey WHERE n >= 3 AND p_size % 2 <> 0""",
    nodes=False,
)
def base_class_should_be_abstract(spark, sf_dir):
    return smells.base_class_should_be_abstract(_classes(spark, sf_dir)).select("subject", "value")


@query(
    """WITH c AS (SELECT p_partkey // 3 AS p, count(*) AS n FROM part WHERE p_partkey >= 3 GROUP BY 1)
    SELECT CAST(p_partkey AS VARCHAR) AS subject, CAST(coalesce(n, 0) AS BIGINT) AS value FROM part LEFT JOIN c ON p = p_partkey WHERE coalesce(n, 0) < 2 AND p_size % 2 = 0""",
    nodes=False,
)
def speculative_generality(spark, sf_dir):
    return smells.speculative_generality(_classes(spark, sf_dir)).select("subject", "value")


@query(
    """WITH RECURSIVE up AS (SELECT p_partkey AS name, p_partkey // 3 AS a, 1 AS depth FROM part WHERE p_partkey >= 3 UNION ALL SELECT name, a // 3, depth + 1 FROM up WHERE a >= 3)
    SELECT CAST(name AS VARCHAR) AS subject, CAST(max(depth) + 1 AS BIGINT) AS value FROM up GROUP BY name HAVING max(depth) + 1 > 4""",
    nodes=False,
)
def deep_inheritance(spark, sf_dir):
    return smells.deep_inheritance(_classes(spark, sf_dir)).select("subject", "value")


_CHANNEL_SQL = """ev AS (SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
        concat('ch', CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR)) AS channel,
        CASE event_type WHEN 'click' THEN 'send' WHEN 'error' THEN 'close' WHEN 'signup' THEN 'receive' ELSE 'open' END AS verb FROM events)"""


def _channel_nodes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    verb = F.when(F.col("event_type") == "click", "send").when(F.col("event_type") == "error", "close").when(F.col("event_type") == "signup", "receive").otherwise("open")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.get_json_object("props", "$.k").cast("bigint") % 3
    return e.select(F.col("user_id").cast("string").alias("file"), line.alias("line"), line.cast("bigint").alias("ord"), F.lit("call").alias("node_type"), F.concat(F.lit("ch"), k.cast("string"), F.lit("."), verb).alias("name"))


@query(
    f"""WITH {_CHANNEL_SQL} SELECT file, CAST(min(line) FILTER (verb = 'send') AS INTEGER) AS line, channel AS subject, count(*) FILTER (verb = 'send') AS value
    FROM ev GROUP BY file, channel HAVING count(*) FILTER (verb = 'send') > 0 AND count(*) FILTER (verb = 'receive') = 0""",
    nodes=False,
)
def muted_pack(spark, sf_dir):
    return smells.muted_pack(_channel_nodes(spark, sf_dir)).select("file", "line", "subject", "value")


@query(
    f"""WITH {_CHANNEL_SQL}, r AS (SELECT file, channel, min(line) AS first FROM ev WHERE verb = 'receive' GROUP BY ALL)
    SELECT ev.file, CAST(ev.line AS INTEGER) AS line, ev.channel AS subject FROM ev JOIN r USING (file, channel) WHERE verb = 'close' AND line < first""",
    nodes=False,
)
def dead_letter(spark, sf_dir):
    return smells.dead_letter(_channel_nodes(spark, sf_dir)).select("file", "line", "subject")


_WORDS_SQL = "SELECT doc_id, unnest(regexp_split_to_array(text, '[\\x09-\\x0D\\x20]+')) AS word FROM documents"


@query(f"SELECT doc_id, word FROM ({_WORDS_SQL}) WHERE length(word) >= 20 AND regexp_matches(word, '^(sk_|sk_live_|sk_test_|ghp_|gho_|ghu_|ghs_|AKIA|ASIA|AIza|xoxb-|xoxp-|xoxa-|eyJ|-----BEGIN RSA PRIVATE KEY-----)')", nodes=False)
def secret_literals(spark, sf_dir):
    return text_lint.secret_literals(table(spark, sf_dir, "documents"), "doc_id")


@query(
    f"""SELECT doc_id, word FROM ({_WORDS_SQL}) WHERE regexp_matches(word, '^(https?|ftp|wss?)://|^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$')
    AND NOT regexp_matches(word, '^(https?://)?(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0)')""",
    nodes=False,
)
def address_literals(spark, sf_dir):
    return text_lint.address_literals(table(spark, sf_dir, "documents"), "doc_id")


@query(
    """SELECT doc_id, lower(kind) AS kind, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(password|passwd|token|secret|api_key|apikey)\\s*=\\s*"?([0-9A-Za-z_-]{8,})', 1)) AS kind
    FROM documents) GROUP BY ALL""",
    nodes=False,
)
def assigned_secrets(spark, sf_dir):
    return text_lint.assigned_secrets(table(spark, sf_dir, "documents"), "doc_id")


@query(
    """SELECT md5(line) AS line_md5, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE length(line) >= 30 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""",
    nodes=False,
)
def repeated_lines(spark, sf_dir):
    return text_lint.repeated_lines(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script[ >]')) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, '(?i)<script[ >]')", nodes=False)
def page_script_use(spark, sf_dir):
    return text_lint.tag_use(table(spark, sf_dir, "pages"), "script")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a[ >]')) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, '(?i)<a[ >]')", nodes=False)
def page_anchor_use(spark, sf_dir):
    return text_lint.tag_use(table(spark, sf_dir, "pages"), "a")


@query("""SELECT target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY target""", nodes=False)
def page_links(spark, sf_dir):
    return text_lint.links(table(spark, sf_dir, "pages"))


@query(
    """WITH b AS (SELECT o_orderkey AS path, o_orderstatus AS c FROM orders WHERE o_orderkey % 10 <> 1), a AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS c FROM orders WHERE o_orderkey % 10 <> 2)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM b FULL JOIN a ON a.path = b.path WHERE b.path IS NULL OR a.path IS NULL OR a.c IS DISTINCT FROM b.c""",
    nodes=False,
)
def change_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("cksum"))
    later = o.withColumn("cksum", F.when(F.col("path") % 7 == 0, "X").otherwise(F.col("cksum")))
    return changes.change_set(o.where("path % 10 <> 1"), later.where("path % 10 <> 2"))


@query(
    """WITH m AS (SELECT o_orderkey AS repo, (epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 2592000.0 AS m, o_orderkey % 100 AS issues, o_orderkey % 20 AS prs, o_orderstatus = 'F' AS retired FROM orders),
    s AS (SELECT repo, CASE WHEN m > 12 THEN 2 WHEN m > 6 THEN 1 ELSE 0 END + CASE WHEN m > 12 THEN 3 ELSE 0 END + CASE WHEN issues > 50 THEN 1 ELSE 0 END
        + CASE WHEN prs > 10 THEN 1 ELSE 0 END + CASE WHEN retired THEN 5 ELSE 0 END AS score FROM m)
    SELECT repo, score, CASE WHEN score >= 6 THEN 'critical' WHEN score >= 3 THEN 'warning' ELSE 'clean' END AS level FROM s""",
    nodes=False,
)
def staleness_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    repos = o.select(F.col("o_orderkey").alias("repo"), F.col("o_orderdate").alias("pushed_at"), F.col("o_orderdate").alias("last_release"), (F.col("o_orderkey") % 100).alias("open_issues"), (F.col("o_orderkey") % 20).alias("open_prs"), (F.col("o_orderstatus") == "F").alias("retired"))
    return changes.staleness(repos, F.lit("1999-01-01").cast("timestamp")).select("repo", "score", "level")


@query(
    """WITH v AS (SELECT s_nationkey AS n, max(CASE WHEN lower(left(CASE WHEN s_acctbal < 0 THEN 'CRITICAL' WHEN s_acctbal < 3000 THEN 'moderate' ELSE 'low' END, 4)) IN ('crit', 'high') THEN 2 ELSE 1 END) AS r, count(*) AS c FROM supplier GROUP BY 1)
    SELECT n_name AS name, CAST(coalesce(c, 0) AS BIGINT) AS n_vulns, CASE coalesce(r, 0) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'clean' END AS level FROM nation LEFT JOIN v ON n = n_nationkey""",
    nodes=False,
)
def dependency_audit(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    deps = nation.select(F.col("n_name").alias("name"), F.lit("1.0").alias("version"))
    sev = F.when(F.col("s_acctbal") < 0, "CRITICAL").when(F.col("s_acctbal") < 3000, "moderate").otherwise("low")
    adv = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), sev.alias("severity"), F.lit(False).alias("failed"))
    stale = deps.select("name", F.lit("clean").alias("level"))
    return changes.audit(deps, adv, stale).select("name", "n_vulns", "level")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^(.*/)?[^/]*1[^/]*$')", nodes=False)
def glob_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(P.glob_to_regex("**/*1*"))).select("page_id")


@query(
    TAINT
    + """, hits AS (SELECT n.file, n.line, n.arg_var AS var FROM nodes n JOIN closure c ON c.file = n.file AND c.var = n.arg_var WHERE n.node_type = 'call'),
    last AS (SELECT file, name, arg_max(arg_var, line) AS next FROM nodes WHERE node_type = 'assign' GROUP BY ALL),
    trace AS (
        SELECT file, line, var, var AS here, 1 AS steps, [var] AS seen FROM hits
        UNION ALL
        SELECT t.file, t.line, t.var, l.next, steps + 1, list_append(seen, l.next) FROM trace t JOIN last l ON l.file = t.file AND l.name = t.here WHERE NOT list_contains(seen, l.next))
    SELECT file, line, var, CAST(max(steps) + 1 AS INTEGER) AS steps FROM trace GROUP BY file, line, var""",
    recursive=True,
)
def vulnerability_flows(spark, sf_dir):
    n = durable(nodes_of(spark, sf_dir))
    known = taint.analyse(n)
    hits = durable(taint.sink_hits(n.where("node_type = 'call'"), known))
    flows = taint.traced_flow(n, hits, known)
    return flows.join(hits.select("file", "ord", "line"), ["file", "ord"]).select("file", "line", "var", F.size("flow").alias("steps"))


@query(
    TAINT
    + """, hits AS (SELECT n.file, n.line, n.name AS sink, n.arg_var AS var FROM nodes n JOIN closure c ON c.file = n.file AND c.var = n.arg_var WHERE n.node_type = 'call'),
    last AS (SELECT file, name, arg_max(arg_var, line) AS next, max(line) AS a_line FROM nodes WHERE node_type = 'assign' GROUP BY ALL),
    trace AS (
        SELECT file, line, sink, var, [var] AS seen FROM hits
        UNION ALL
        SELECT t.file, t.line, t.sink, t.var, list_append(seen, l.next) FROM trace t JOIN last l ON l.file = t.file AND l.name = t.seen[-1] WHERE NOT list_contains(seen, l.next)),
    longest AS (SELECT file, line, sink, var, arg_max(seen, len(seen)) AS seen FROM trace GROUP BY ALL),
    steps AS (SELECT file, line, sink, var, unnest(seen) AS name, generate_subscripts(seen, 1) AS nth FROM longest)
    SELECT s.file, s.line, s.var, concat(string_agg(CASE WHEN a_line IS NULL THEN concat('0 source ', s.name) ELSE concat(a_line, ' assign ', s.name) END, '; ' ORDER BY nth DESC), '; ', s.line, ' sink ', any_value(sink)) AS flow
    FROM steps s LEFT JOIN last l ON l.file = s.file AND l.name = s.name GROUP BY s.file, s.line, s.var""",
    recursive=True,
)
def vulnerability_flow_steps(spark, sf_dir):
    """Every step of every flow, source first."""
    n = durable(nodes_of(spark, sf_dir))
    known = taint.analyse(n)
    hits = durable(taint.sink_hits(n.where("node_type = 'call'"), known))
    flows = taint.traced_flow(n, hits, known).join(hits.select("file", "ord", "line"), ["file", "ord"])
    return flows.select("file", "line", "var", F.array_join(F.transform("flow", lambda x: F.concat_ws(" ", x["line"], x["message"])), "; ").alias("flow"))


@query()
def cfg_findings(spark, sf_dir):
    """Functions of the fixture as straight code with open branches; the first parameter is tainted."""
    inside = scopes.with_scope(nodes_of(spark, sf_dir)).where("scope_line IS NOT NULL AND node_type <> 'def'")
    kind = F.when(F.col("node_type") == "control", "branch").otherwise(F.col("node_type"))
    fn = F.concat_ws(":", "scope_name", "scope_line")
    il = inside.select("file", fn.alias("fn"), "ord", kind.alias("kind"), F.when(F.col("node_type") == "assign", F.col("name")).alias("lhs"), F.when(F.col("node_type") == "call", F.col("name")).alias("callee"), F.col("args.value").alias("args"), "line")
    params = nodes_of(spark, sf_dir).where("node_type = 'def'").select("file", F.concat_ws(":", "name", "line").alias("fn"), F.col("args.value").alias("params"))
    rules = [{"rule": "CommandInjection", "pattern": "fn", "match": "substring", "arg": 0, "sanitizers": []}]
    return cfg.cfg_findings(il, rules, ("v",), ("fn24",), params)


@query()
def all_smells(spark, sf_dir):
    return smells.all_smells(nodes_of(spark, sf_dir))


@query(
    """, t AS (SELECT file, line, CASE node_type WHEN 'call' THEN concat('Call|', name, '|1') WHEN 'assign' THEN 'Assign|_|1' WHEN 'def' THEN 'Def|_|1' ELSE concat(node_type, '|_|0') END AS norm FROM nodes),
    f AS (SELECT file, line, list(norm) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS frame FROM t),
    m AS (SELECT file, line, md5(array_to_string(frame, '|')) AS hash FROM f WHERE len(frame) = 3)
    SELECT 'DRYViolation' AS rule, 'Medium' AS severity, min((file, line))[1] AS file, min((file, line))[2] AS line, hash AS subject, count(DISTINCT (file, line)) AS value FROM m
    GROUP BY hash HAVING count(DISTINCT (file, line)) >= 4 AND count(DISTINCT file) >= 2"""
)
def dry_violations(spark, sf_dir):
    return smells.dry_violation(nodes_of(spark, sf_dir), smells.Limits(window=3))


@query(
    TAINT
    + """ SELECT DISTINCT s.file, s.scope_name AS func_name FROM scoped s LEFT JOIN closure c ON c.file = s.file AND c.var = s.name
    WHERE s.node_type = 'assign' AND s.scope_line IS NOT NULL AND (c.var IS NOT NULL OR s.taint)""",
    recursive=True,
)
def tainted_returns(spark, sf_dir):
    n = durable(nodes_of(spark, sf_dir))
    return taint.tainted_returns(n, taint.analyse(n))


@query(
    REACHED
    + """, names AS (SELECT caller AS name FROM edges UNION SELECT callee FROM edges)
    SELECT n.name, CASE WHEN n.name = 'fn7' THEN 'Sink' WHEN n.name = 'fn2' THEN 'Entry' WHEN r.name IS NOT NULL THEN 'Reachable' ELSE 'Dormant' END AS class
    FROM names n LEFT JOIN reached r ON r.name = n.name""",
    recursive=True,
)
def call_graph_classes(spark, sf_dir):
    n = durable(nodes_of(spark, sf_dir))
    edges, entries = reach.call_edges(n), reach.entry_points(n, ["fn2"]).where("name = 'fn2'")
    return reach.classified(edges, entries, n.where("name = 'fn7'"), reach.reachable(edges, entries))


@query(
    """SELECT n_name AS name, coalesce(bool_or(s_acctbal > 5000), false) AS reachable FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
    nodes=False,
)
def dependency_reachability(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    imports = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("file"), F.concat_ws("/", "n_name", "s_name").alias("module"))
    live = supplier.where("s_acctbal > 5000").select(F.col("s_name").alias("file"))
    return changes.dependency_reachability(nation.select(F.col("n_name").alias("name")), imports, live)


@query(
    """SELECT CASE WHEN t >= 3 THEN 'later' ELSE 'first' END AS part, role, count(*) AS n, max(length(text)) AS longest FROM (SELECT turn AS t, role, text FROM conversations) GROUP BY ALL""",
    nodes=False,
)
def conversation_mix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.when(F.col("turn") >= 3, "later").otherwise("first").alias("part"), "role").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("bigint").alias("longest"))


QUERIES |= program_queries.QUERIES | tree_queries.QUERIES | module_queries.QUERIES
ORACLES |= program_queries.ORACLES | tree_queries.ORACLES | module_queries.ORACLES
