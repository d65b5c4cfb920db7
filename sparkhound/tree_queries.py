"""Registered queries over a third fixture: orders as syntax trees, their line items as statements, in two languages.

A document is an order's XML, as parsers hand it over. Its oracle has the same trees as rows with parents, made of the statements'
own rows, and climbs from parent to parent; the queries count open intervals.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import documents as whole
from .operators import trees
from .sources.tree_rules import LANGUAGES, tree_rules
from .sources.xml_trees import parse

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_GLEAM_CALL = '<function_call srow="@l" field="value"><identifier field="function">{f}</identifier><arguments field="arguments"><argument>{a}</argument></arguments></function_call>'
_GLEAM_LET = '<let><identifier field="pattern">v@v</identifier>{value}</let>'
_JS_CALL = '<call_expression srow="@l" field="value"><identifier field="function">{f}</identifier><arguments field="arguments">{a}</arguments></call_expression>'
_JS_LET = '<lexical_declaration><variable_declarator><identifier field="name">v@v</identifier>{value}</variable_declarator></lexical_declaration>'
_VAR, _OTHER = "<identifier>v@v</identifier>", "<identifier>v@w</identifier>"
_GLEAM_TEXT = '<string><quoted_content>k@k</quoted_content></string>'
_JS_TEXT = '<string><string_fragment>k@k</string_fragment></string>'
#: Statements by language; @v and @w are variables' numbers, @k a key's, @l the line's.
STATEMENTS = {
    "gleam": [
        _GLEAM_LET.format(value=_GLEAM_CALL.format(f="get_param", a=_GLEAM_TEXT)),
        _GLEAM_LET.format(value=_GLEAM_CALL.format(f="escape", a=_OTHER)),
        _GLEAM_CALL.format(f="exec", a=_OTHER),
        _GLEAM_LET.format(value=_OTHER),
        f'<case><case_subjects field="subjects">{_OTHER}</case_subjects><case_clauses field="clauses"><case_clause><case_clause_patterns field="patterns"><p><integer>1</integer></p></case_clause_patterns>{_GLEAM_CALL.format(f="exec", a=_VAR)}</case_clause>'
        f'<case_clause>{_GLEAM_LET.format(value=_OTHER)}</case_clause><case_clause>{_GLEAM_CALL.format(f="exec", a=_OTHER)}</case_clause></case_clauses></case>',
        _GLEAM_LET.format(value=f'<binary_expression field="value">++{_GLEAM_TEXT}{_OTHER}</binary_expression>'),
        '<function_call srow="@l"><field_access field="function">' + _GLEAM_CALL.format(f="open", a=_OTHER).replace('"value"', '"record"') + '<label field="field">send</label></field_access><arguments field="arguments"><argument>'
        + _GLEAM_CALL.format(f="trim", a=_VAR) + "</argument><argument><field_access><identifier field=\"record\">v@w</identifier><label field=\"field\">host</label></field_access></argument></arguments></function_call>",
        f"<comment>none</comment><block>{_GLEAM_LET.format(value=_OTHER)}{_GLEAM_CALL.format(f='exec', a=_VAR)}</block>",
    ],
    "javascript": [
        _JS_LET.format(value=_JS_CALL.format(f="get_param", a=_JS_TEXT)),
        _JS_LET.format(value=_JS_CALL.format(f="escape", a=_OTHER)),
        f"<expression_statement>{_JS_CALL.format(f='exec', a=_OTHER)}</expression_statement>",
        f'<expression_statement><assignment_expression><identifier field="left">v@v</identifier><identifier field="right">v@w</identifier></assignment_expression></expression_statement>',
        f'<if_statement><parenthesized_expression field="condition"><binary_expression>==<identifier field="left">v@w</identifier><number field="right">@k</number></binary_expression></parenthesized_expression>'
        f'<statement_block field="consequence">{_JS_LET.format(value=_JS_CALL.format(f="escape", a=_OTHER))}</statement_block><else_clause field="alternative"><statement_block>{_JS_CALL.format(f="exec", a=_VAR)}</statement_block></else_clause></if_statement>',
        _JS_LET.format(value=f'<ternary_expression field="value">{_VAR}{_OTHER}{_JS_TEXT}</ternary_expression>'),
        f'<expression_statement><call_expression srow="@l"><member_expression field="function"><identifier field="object">list</identifier><property_identifier field="property">map</property_identifier></member_expression><arguments field="arguments"><arrow_function>'
        f"<formal_parameters><identifier>v@v</identifier></formal_parameters>{_JS_CALL.format(f='exec', a=_VAR)}</arrow_function></arguments></call_expression></expression_statement>",
        f'<try_statement><statement_block>{_JS_LET.format(value=_JS_CALL.format(f="load", a=_OTHER))}</statement_block><catch_clause><statement_block></statement_block></catch_clause></try_statement>',
    ],
}
_HEADS = {
    "gleam": '<source_file><function><identifier field="name">main</identifier><function_parameter><identifier field="name">user_in</identifier></function_parameter><block field="body">',
    "javascript": '<program><function_declaration><identifier field="name">main</identifier><formal_parameters><identifier>user_in</identifier></formal_parameters><statement_block field="body">',
}
_TAILS = {"gleam": "</block></function></source_file>", "javascript": "</statement_block></function_declaration></program>"}
KINDS = 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content, language): an order's document."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    language = F.when(F.col("l_orderkey") % 2 == 0, "gleam").otherwise("javascript")
    by = F.map_from_arrays(F.array(*[F.lit(x) for x in STATEMENTS]), F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in STATEMENTS.values()]))
    number = lambda x, n: (x % n).cast("long").cast("string")

    def statement(x):
        text = F.get(by[F.col("language")], (x["l_partkey"] % KINDS).cast("int"))
        for place, value in (("@v", number(x["l_partkey"], 7)), ("@w", number(x["l_suppkey"], 7)), ("@k", number(x["l_suppkey"], 5)), ("@l", x["l_linenumber"].cast("string"))):
            text = F.replace(text, F.lit(place), value)
        return text

    # texts follow from the numbers, so only these are sent and sorted
    d = li.groupBy("l_orderkey", language.alias("language")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("items"))
    d = d.withColumn("body", F.array_join(F.transform("items", statement), ""))
    pick = lambda parts: F.when(F.col("language") == "gleam", parts["gleam"]).otherwise(parts["javascript"])
    return d.select(F.col("l_orderkey").cast("string").alias("file"), F.concat(pick(_HEADS), "body", pick(_TAILS)).alias("content"), "language")


def _sql_rows() -> tuple[str, str, str]:
    """VALUES of the statements' nodes, of the documents' heads and of the tree rules."""
    quoted = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    nodes, heads, rules = [], [], []
    for language, texts in STATEMENTS.items():
        for kind, text in enumerate(texts):
            found = parse(f"<r>{text}</r>")[0][1:]  # without the root added here
            nodes += [f"({quoted(language)}, {kind}, {n[0] - 1}, {'NULL' if n[1] == 0 else n[1] - 1}, {quoted(n[6])}, {quoted(n[7])}, {quoted(n[8])}, {str(n[5] == n[0]).lower()}, {len(found)})" for n in found]
        found = parse(_HEADS[language] + _TAILS[language])[0]
        heads += [f"({quoted(language)}, {n[0]}, {'NULL' if n[1] is None else n[1]}, {quoted(n[6])}, {quoted(n[7])}, {quoted(n[8])}, {str(n[5] == n[0]).lower()}, {len(found)})" for n in found]
    for language in STATEMENTS:
        rules += [f"({quoted(language)}, {', '.join(map(quoted, r))})" for r in LANGUAGES[language]]
    return ",\n".join(nodes), ",\n".join(heads), ",\n".join(rules)


_NODES, _HEAD_NODES, _RULES = _sql_rows()
NODES = f"""
tpl(lang, stmt, off, up, tag, field, txt, leaf, size) AS (VALUES {_NODES}),
head(lang, id, up, tag, field, txt, leaf, size) AS (VALUES {_HEAD_NODES}),
rule(lang, tag, field, kind, role, literal_kind) AS (VALUES {_RULES}),
items AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS file, CASE WHEN l_orderkey % 2 = 0 THEN 'gleam' ELSE 'javascript' END AS lang, CAST(l_partkey % {KINDS} AS INTEGER) AS stmt, CAST(l_partkey AS BIGINT) % 7 AS v, CAST(l_suppkey AS BIGINT) % 7 AS w,
        CAST(l_suppkey AS BIGINT) % 5 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth FROM lineitem),
sizes AS (SELECT DISTINCT lang, stmt, size FROM tpl),
starts AS (SELECT i.*, coalesce(sum(s.size) OVER (PARTITION BY file ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM items i JOIN sizes s USING (lang, stmt)),
lasts AS (SELECT lang, max(id) AS last FROM head GROUP BY lang),
node AS (
    SELECT f.file, h.lang, CAST(h.id AS BIGINT) AS id, CAST(h.up AS BIGINT) AS up, h.tag, h.field, h.txt, h.leaf AND h.id <> l.last AS leaf FROM (SELECT DISTINCT file, lang FROM items) f JOIN head h USING (lang) JOIN lasts l USING (lang)
    UNION ALL
    SELECT s.file, s.lang, CAST(l.last + 1 + start + off AS BIGINT), CAST(CASE WHEN t.up IS NULL THEN l.last ELSE l.last + 1 + start + t.up END AS BIGINT), t.tag, t.field, replace(replace(replace(txt, '@v', v::VARCHAR), '@w', w::VARCHAR), '@k', k::VARCHAR), leaf
    FROM starts s JOIN tpl t USING (lang, stmt) JOIN lasts l USING (lang)),
ruled AS (
    SELECT n.*, CASE WHEN coalesce(a.tag, b.field, c.tag) IS NULL AND leaf AND txt <> '' THEN 'var' WHEN a.tag IS NOT NULL THEN a.kind WHEN b.field IS NOT NULL THEN b.kind ELSE c.kind END AS kind0,
        CASE WHEN a.tag IS NOT NULL THEN a.role WHEN b.field IS NOT NULL THEN b.role ELSE c.role END AS role, CASE WHEN a.tag IS NOT NULL THEN a.literal_kind WHEN b.field IS NOT NULL THEN b.literal_kind ELSE c.literal_kind END AS literal_kind
    FROM node n LEFT JOIN rule a ON a.lang = n.lang AND a.tag = n.tag AND a.field = n.field LEFT JOIN rule b ON b.lang = n.lang AND b.tag = '*' AND b.field = n.field LEFT JOIN rule c ON c.lang = n.lang AND c.tag = n.tag AND c.field IS NULL),
anc(file, id, a, d) AS (SELECT file, id, up, 1 FROM ruled WHERE up IS NOT NULL UNION ALL SELECT x.file, x.id, n.up, d + 1 FROM anc x JOIN node n ON n.file = x.file AND n.id = x.a AND n.up IS NOT NULL),
whole AS (SELECT * FROM ruled r WHERE coalesce(role, '') <> 'drop' AND NOT EXISTS (SELECT 1 FROM anc x JOIN ruled y ON y.file = x.file AND y.id = x.a AND y.role = 'drop' WHERE x.file = r.file AND x.id = r.id)),
marked AS (
    SELECT w.*, m.role AS m_role FROM whole w LEFT JOIN (
        SELECT x.file, x.id, min_by({{'r': y.role}}, x.d).r AS role FROM anc x JOIN whole y ON y.file = x.file AND y.id = x.a WHERE y.kind0 IS NOT NULL OR y.role IN ('name', 'pattern', 'self', 'params') GROUP BY x.file, x.id
    ) m ON m.file = w.file AND m.id = w.id),
kept0 AS (
    SELECT *, CASE WHEN kind0 = 'var' AND m_role = 'params' THEN 'param' ELSE kind0 END AS kind, coalesce(m_role IN ('name', 'pattern', 'self'), false) AS inside FROM marked),
kept1 AS (SELECT *, kind IS NOT NULL AND NOT (kind IN ('var', 'field') AND inside) AND coalesce(m_role, '') <> 'pattern' AS kept FROM kept0),
near AS (SELECT x.file, x.id, arg_min(x.a, x.d) AS k, count(*) AS k_level FROM anc x JOIN kept1 y ON y.file = x.file AND y.id = x.a AND y.kept GROUP BY x.file, x.id),
names AS (
    SELECT n.file, n.k AS id, CASE WHEN count(*) FILTER (c.role = 'pattern' OR c.m_role = 'pattern') > 1 THEN '_' WHEN count(*) FILTER (c.role = 'pattern' OR c.m_role = 'pattern') = 1 THEN min(c.txt) FILTER (c.role = 'pattern' OR c.m_role = 'pattern') ELSE string_agg(c.txt, '.' ORDER BY c.id) END AS named
    FROM kept1 c JOIN near n USING (file, id) WHERE leaf AND txt <> '' AND NOT kept AND (inside OR role IN ('name', 'pattern', 'self')) GROUP BY n.file, n.k),
tops AS (SELECT file, min(id) AS fn_node FROM kept1 WHERE kept AND kind = 'function' GROUP BY file),
expr0 AS (
    SELECT c.file, c.id, n.k, concat('main@', t.fn_node) AS fn_id, c.kind, c.inside AS receiver, CASE WHEN c.kind IN ('literal', 'binary', 'unary', 'block', 'if', 'case', 'try', 'ternary', 'while', 'list', 'tuple', 'record') THEN '' ELSE coalesce(s.named, c.txt) END AS name,
        c.literal_kind, CASE WHEN c.kind = 'literal' THEN coalesce(s.named, c.txt) END AS literal, CASE WHEN c.kind IN ('binary', 'unary') THEN c.txt END AS op, CAST(coalesce(n.k_level, 0) AS INTEGER) AS depth,
        row_number() OVER (PARTITION BY c.file ORDER BY c.id) - 1 AS expr_id
    FROM kept1 c JOIN tops t USING (file) LEFT JOIN near n USING (file, id) LEFT JOIN names s USING (file, id) WHERE c.kept),
ends AS (SELECT x.file, x.a AS id, max(y.expr_id) AS last FROM anc x JOIN expr0 y ON y.file = x.file AND y.id = x.id GROUP BY x.file, x.a),
expr AS (
    SELECT e.file, e.fn_id, e.expr_id, p.expr_id AS parent_id, CAST(CASE WHEN e.receiver THEN -1 ELSE count(*) FILTER (NOT e.receiver) OVER (PARTITION BY e.file, e.k ORDER BY e.id) - 1 END AS INTEGER) AS child_ix,
        e.kind, e.name, e.literal_kind, e.literal, e.op, e.depth, coalesce(z.last, e.expr_id) AS subtree_end
    FROM expr0 e LEFT JOIN expr0 p ON p.file = e.file AND p.id = e.k LEFT JOIN ends z ON z.file = e.file AND z.id = e.id)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH RECURSIVE {NODES}{oracle}"
        return f

    return add


def _expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.document_expressions(documents(spark, sf_dir), tree_rules(spark)).drop("language")


@query(" SELECT file, fn_id, expr_id, parent_id, child_ix, kind, name, literal_kind, literal, op, depth, subtree_end FROM expr")
def tree_expressions(spark, sf_dir):
    """Syntax trees of two languages as expression rows."""
    return _expressions(spark, sf_dir).select("file", "fn_id", "expr_id", "parent_id", "child_ix", "kind", "name", "literal_kind", "literal", "op", "depth", "subtree_end")


#: The same events, sorted by paths from the root instead of positions.
STATEMENTS_SQL = """,
walk(file, expr_id, path, owner, used) AS (
    SELECT file, expr_id, [expr_id], NULL::BIGINT, false FROM expr WHERE parent_id IS NULL
    UNION ALL
    SELECT e.file, e.expr_id, list_append(w.path, e.expr_id), CASE WHEN p.kind IN ('function', 'lambda') THEN p.expr_id ELSE w.owner END,
        CASE WHEN p.kind IN ('app', 'binary', 'unary', 'let', 'assign', 'return', 'raise', 'field', 'tuple', 'list', 'record', 'error') THEN true
            WHEN p.kind = 'block' AND e.child_ix = p.top OR p.kind IN ('if', 'ternary', 'case', 'while') AND e.child_ix > 0 THEN w.used ELSE false END
    FROM walk w JOIN (SELECT e.*, (SELECT max(child_ix) FROM expr c WHERE c.file = e.file AND c.parent_id = e.expr_id) AS top FROM expr e) p ON p.file = w.file AND p.expr_id = w.expr_id
    JOIN expr e ON e.file = p.file AND e.parent_id = p.expr_id),
named AS (
    SELECT e.*, w.path, w.used, w.owner, CASE WHEN kind IN ('var', 'field', 'param') AND subtree_end = e.expr_id AND name <> '' THEN name WHEN kind = 'literal' THEN concat('"', literal, '"') ELSE concat('%', e.expr_id) END AS operand
    FROM expr e JOIN walk w USING (file, expr_id)),
kids AS (SELECT file, parent_id AS expr_id, count(*) AS n, list(operand ORDER BY expr_id) AS vals, coalesce(list(operand ORDER BY expr_id) FILTER (child_ix >= 0), []) AS args, max(child_ix) AS top FROM named WHERE parent_id IS NOT NULL GROUP BY ALL),
il_rows AS (
    SELECT n.file, n.fn_id, n.owner, n.expr_id, n.path, n.kind, n.name, n.op, n.used, n.operand, n.child_ix, n.parent_id, coalesce(k.n, 0) AS n_kids, coalesce(k.vals, []) AS vals, coalesce(k.args, []) AS args, p.kind AS p_kind, pk.top AS p_top,
        list_append(n.path, 1000000000) AS leave
    FROM named n LEFT JOIN kids k ON k.file = n.file AND k.expr_id = n.expr_id LEFT JOIN expr p ON p.file = n.file AND p.expr_id = n.parent_id LEFT JOIN kids pk ON pk.file = n.file AND pk.expr_id = n.parent_id WHERE n.owner IS NOT NULL),
events AS (
    SELECT file, fn_id, owner, path AS place, 0 AS step, 'else' AS kind, NULL AS lhs, NULL AS callee, [] AS args FROM il_rows WHERE p_kind IN ('if', 'ternary', 'while') AND child_ix = 2
    UNION ALL SELECT file, fn_id, owner, path, 0, 'branch', NULL, NULL, [] FROM il_rows WHERE p_kind = 'case' AND child_ix >= 1 AND child_ix < p_top
    UNION ALL SELECT file, fn_id, owner, leave, 0, 'call', NULL, name, args FROM il_rows WHERE kind = 'app'
    UNION ALL SELECT file, fn_id, owner, leave, 1, 'assign', concat('%', expr_id), CASE WHEN kind = 'app' THEN name WHEN kind IN ('binary', 'unary') THEN op END, CASE WHEN kind <> 'block' THEN vals WHEN n_kids = 0 THEN [] ELSE vals[len(vals):len(vals)] END
        FROM il_rows WHERE used AND (kind IN ('app', 'binary', 'unary', 'tuple', 'list', 'record', 'block') OR kind = 'field' AND n_kids > 0)
    UNION ALL SELECT file, fn_id, owner, leave, 2, 'assign', name, NULL, vals FROM il_rows WHERE kind IN ('let', 'assign') AND name <> ''
    UNION ALL SELECT file, fn_id, owner, leave, 3, 'return', NULL, NULL, vals FROM il_rows WHERE kind IN ('return', 'raise', 'error')
    UNION ALL SELECT file, fn_id, owner, leave, 3, 'call', NULL, 'try', ['%try'] FROM il_rows WHERE kind = 'try'
    UNION ALL SELECT file, fn_id, owner, leave, 7, 'assign', concat('%', parent_id), NULL, [operand] FROM il_rows WHERE p_kind IN ('if', 'ternary', 'while', 'case') AND child_ix > 0 AND used
    UNION ALL SELECT file, fn_id, owner, leave, 8, 'branch', NULL, NULL, [operand] FROM il_rows WHERE p_kind IN ('if', 'ternary', 'while') AND child_ix = 0
    UNION ALL SELECT file, fn_id, owner, leave, 9, 'else', NULL, NULL, [] FROM il_rows WHERE p_kind = 'case' AND child_ix >= 1 AND child_ix < p_top
    UNION ALL SELECT file, fn_id, owner, leave, 4, 'end', NULL, NULL, [] FROM il_rows WHERE kind IN ('if', 'ternary', 'while') AND n_kids > 0
    UNION ALL SELECT file, fn_id, owner, leave, 4, 'end', NULL, NULL, [] FROM il_rows, range(1, greatest(n_kids - 1, 1)) WHERE kind = 'case'),
il AS (SELECT file, CASE WHEN owner = 0 THEN fn_id ELSE concat(fn_id, '/', owner) END AS fn, row_number() OVER (PARTITION BY file, owner ORDER BY place, step) AS ord, kind, lhs, callee, args FROM events)"""


@query(STATEMENTS_SQL + " SELECT file, fn, ord, kind, lhs, callee, array_to_string(args, ', ') AS args FROM il")
def tree_statements(spark, sf_dir):
    """The statements of the trees' functions in order, with temporaries and branches."""

    def found(file, _, rows):
        ils = [il for tree in whole.trees(rows) for il in whole.statements(tree).items()]
        return [(file, fn, ord_, kind, lhs, callee, ", ".join(args)) for fn, il in ils for ord_, (kind, lhs, callee, args, _) in enumerate(il, 1)]

    return trees.by_document(documents(spark, sf_dir), tree_rules(spark), found, "file string, fn string, ord bigint, kind string, lhs string, callee string, args string")


SINKS = [{"rule": "CommandInjection", "pattern": "exec", "match": "exact", "arg": 0, "sanitizers": []}]


@query()
def tree_flow_findings(spark, sf_dir):
    """Sinks reached by taint along the control flow of the trees' functions: from source text to finding."""
    found = lambda file, _, rows: [(file, *f) for f in whole.flow_findings(rows, SINKS, ("get_param", "user_"), ("escape",))]
    return trees.by_document(documents(spark, sf_dir), tree_rules(spark), found, "file string, fn string, rule string, line int, callee string, status string")


#: What the fixture's calls return.
RETURNS = {"gleam": {"result": ["exec"], "safe": ["escape", "trim"], "nullable": ["open"]}, "javascript": {"nullable": ["load", "get_param"], "safe": ["escape", "map"]}}
_RETURN_ROWS = ", ".join(f"('{language}', '{name}', '{kind}')" for language, kinds in RETURNS.items() for kind, names in kinds.items() for name in names)
TYPES_SQL = f""",
ret(lang, name, k) AS (VALUES {_RETURN_ROWS}),
tops_ AS (SELECT file, parent_id AS expr_id, max(child_ix) AS top FROM expr WHERE parent_id IS NOT NULL GROUP BY ALL),
binding AS (SELECT file, expr_id, name FROM expr WHERE kind IN ('let', 'assign', 'param') AND name <> ''),
last_bound AS (SELECT v.file, v.expr_id, max(b.expr_id) AS at FROM expr v JOIN binding b ON b.file = v.file AND b.expr_id < v.expr_id AND b.name = CASE WHEN v.kind IN ('app', 'field') THEN split_part(v.name, '.', 1) ELSE v.name END WHERE v.kind IN ('var', 'app', 'field') GROUP BY ALL),
flow AS (
    SELECT e.file, e.expr_id AS src, p.expr_id AS dst FROM expr e JOIN expr p ON p.file = e.file AND p.expr_id = e.parent_id JOIN tops_ t ON t.file = p.file AND t.expr_id = p.expr_id
    WHERE p.kind IN ('let', 'assign', 'block') AND e.child_ix = t.top OR p.kind IN ('if', 'ternary', 'case') AND e.child_ix > 0
    UNION ALL SELECT v.file, l.at, v.expr_id FROM expr v JOIN last_bound l USING (file, expr_id) WHERE v.kind = 'var'),
langs AS (SELECT DISTINCT file, lang FROM items),
reached(file, expr_id, k) AS (
    SELECT e.file, e.expr_id, CASE WHEN e.kind = 'app' THEN coalesce(r.k, r2.k, 'unknown') WHEN e.kind = 'literal' THEN 'safe' WHEN e.kind IN ('binary', 'list', 'tuple', 'lambda') THEN 'safe' WHEN e.kind = 'if' THEN 'nullable' ELSE 'unknown' END
    FROM expr e JOIN langs USING (file) LEFT JOIN ret r ON r.lang = langs.lang AND r.name = e.name LEFT JOIN ret r2 ON r2.lang = langs.lang AND r2.name = split_part(e.name, '.', -1) LEFT JOIN tops_ t ON t.file = e.file AND t.expr_id = e.expr_id LEFT JOIN last_bound l ON l.file = e.file AND l.expr_id = e.expr_id
    WHERE e.kind IN ('app', 'literal', 'binary', 'list', 'tuple', 'lambda', 'field', 'param', 'try') OR e.kind = 'if' AND t.top = 1 OR e.kind = 'var' AND l.at IS NULL
    UNION
    SELECT f.file, f.dst, r.k FROM reached r JOIN flow f ON f.file = r.file AND f.src = r.expr_id),
kinds AS (SELECT file, expr_id, CASE WHEN count(*) = 1 THEN min(k) WHEN bool_and(k IN ('safe', 'nullable')) THEN 'nullable' ELSE 'unknown' END AS value FROM reached GROUP BY ALL)"""


#: The same by language and name; of several kinds of a name the least.
_KIND_OF = {language: dict(sorted(((name, kind) for kind, names in kinds.items() for name in names), reverse=True)) for language, kinds in RETURNS.items()}


@query(TYPES_SQL + " SELECT e.file, e.fn_id, k.expr_id, k.value FROM kinds k JOIN expr e USING (file, expr_id)")
def tree_value_kinds(spark, sf_dir):
    """Which expressions may be nil or an error, from what calls return."""

    def found(file, language, rows):
        known = [(tree, whole.value_kinds(tree, _KIND_OF.get(language, {}))) for tree in whole.trees(rows)]
        return [(file, r[whole.FN], r[whole.ID], k) for tree, kinds in known for r, k in zip(tree, kinds, strict=True) if k]

    return trees.by_document(documents(spark, sf_dir), tree_rules(spark), found, "file string, fn_id string, expr_id bigint, value string")


@query(
    TYPES_SQL
    + """, hits AS (
    SELECT 'ignored-result' AS rule, e.file, e.line_name AS subject FROM (SELECT e.*, e.name AS line_name FROM expr e JOIN expr p ON p.file = e.file AND p.expr_id = e.parent_id AND p.kind = 'block' JOIN tops_ t ON t.file = p.file AND t.expr_id = p.expr_id
        JOIN kinds k ON k.file = e.file AND k.expr_id = e.expr_id AND k.value = 'result' WHERE e.kind = 'app' AND e.child_ix <> t.top) e
    UNION ALL SELECT 'unchecked-nullable', file, name FROM (
        SELECT e.file, e.expr_id, e.name FROM expr e JOIN last_bound l USING (file, expr_id) JOIN kinds k ON k.file = e.file AND k.expr_id = l.at AND k.value = 'nullable' WHERE e.kind IN ('app', 'field') AND contains(e.name, '.')
        UNION SELECT e.file, e.expr_id, e.name FROM expr e JOIN expr c ON c.file = e.file AND c.parent_id = e.expr_id AND c.child_ix = -1 JOIN kinds k ON k.file = c.file AND k.expr_id = c.expr_id AND k.value = 'nullable' WHERE e.kind IN ('app', 'field'))
    UNION ALL SELECT 'named-call', file, name FROM expr WHERE kind IN ('app', 'field') AND name IN ('exec', 'load')
    UNION ALL SELECT 'text-in-operation', file, p.name FROM expr p WHERE kind = 'binary' AND EXISTS (SELECT 1 FROM expr c WHERE c.file = p.file AND c.parent_id = p.expr_id AND c.kind = 'literal')
    UNION ALL SELECT 'many-calls', file, CAST(count(*) AS VARCHAR) FROM expr WHERE kind = 'app' GROUP BY file HAVING count(*) >= 5
    UNION ALL SELECT 'key-text', file, literal FROM expr WHERE kind = 'literal' AND literal = 'k3'
    UNION ALL SELECT 'run-after-read', e.file, e.name FROM expr e WHERE kind = 'app' AND name = 'exec' AND EXISTS (SELECT 1 FROM expr b WHERE b.file = e.file AND b.kind = 'app' AND b.name = 'get_param' AND b.expr_id < e.expr_id)
    UNION ALL SELECT 'nested-block', file, CAST(n AS VARCHAR) FROM (SELECT e.file, e.expr_id, count(*) AS n FROM expr e JOIN expr o ON o.file = e.file AND o.kind = 'block' AND o.expr_id <= e.expr_id AND e.expr_id <= o.subtree_end WHERE e.kind = 'block' GROUP BY ALL) WHERE n >= 2
    UNION ALL SELECT 'unused-binding', e.file, e.name FROM expr e WHERE kind IN ('let', 'param') AND NOT EXISTS (SELECT 1 FROM expr u WHERE u.file = e.file AND u.kind IN ('var', 'app', 'field') AND split_part(u.name, '.', 1) = e.name AND u.expr_id > e.expr_id)
    UNION ALL SELECT 'shadow-variable', file, name FROM (SELECT file, name, row_number() OVER (PARTITION BY file, name ORDER BY expr_id) AS r FROM expr WHERE kind IN ('let', 'param')) WHERE r > 1)
    SELECT rule, file, subject, count(*) AS n FROM hits GROUP BY ALL"""
)
def tree_lint(spark, sf_dir):
    """Each lint template over the trees, and the two rules that need kinds of values."""
    kind = whole.KIND

    def found(file, language, rows):
        n = Counter()
        for tree in whole.trees(rows):
            known = whole.value_kinds(tree, _KIND_OF.get(language, {}))
            for hits in (
                whole.ignored_results(tree, known), whole.unchecked_nullables(tree, known), whole.name_lookup(tree, {"exec": "named-call", "load": "named-call"}),
                whole.shape(tree, lambda r: r[kind] == "binary", lambda r: r[kind] == "literal", "text-in-operation"), whole.count_over(tree, lambda r: r[kind] == "app", 5, "many-calls"),
                whole.literal_match(tree, lambda x: x == "k3", "key-text"), whole.followed_by(tree, "get_param", "exec", "run-after-read"), whole.nested_deeper(tree, "block", 2, "nested-block"),
                whole.unused_bindings(tree), whole.shadowed(tree),
            ):
                n.update(hits)
        return [(rule, file, subject, k) for (rule, subject), k in n.items()]

    # a file is one document, so its counts are whole where it is parsed
    return trees.by_document(documents(spark, sf_dir), tree_rules(spark), found, "rule string, file string, subject string, n bigint")


@query(
    """, form0 AS (SELECT *, concat_ws(':', kind, CASE WHEN kind IN ('var', 'param', 'let', 'assign') THEN '_' ELSE name END, coalesce(op, ''), coalesce(literal, '')) AS t FROM expr),
    forms AS (
        SELECT a.file, a.expr_id, string_agg(concat_ws('/', d.depth - a.depth, d.t), ' ' ORDER BY d.expr_id) AS form FROM form0 a JOIN form0 d ON d.file = a.file AND d.expr_id BETWEEN a.expr_id AND a.subtree_end AND d.depth <= a.depth + 4
        WHERE a.subtree_end > a.expr_id GROUP BY ALL)
    SELECT md5(form) AS hash, count(DISTINCT file) AS files FROM forms WHERE length(form) >= 40 GROUP BY form HAVING count(DISTINCT file) >= 4"""
)
def tree_duplicates(spark, sf_dir):
    """Subtrees equal up to variable names in four files at least, 40 characters long and four levels deep."""
    found = lambda _, __, rows: [(h,) for h in set().union(*map(whole.forms, whole.trees(rows)))]
    # a file is one document and gives a form once, so rows are files
    forms = trees.by_document(documents(spark, sf_dir), tree_rules(spark), found, "form binary")
    return forms.groupBy("form").agg(F.count("*").alias("files")).where("files >= 4").select(F.lower(F.hex("form")).alias("hash"), "files")
