"""Syntax trees to expression rows (S-12): a contraction of node rows under a table of rules.

Rows that mean nothing vanish and their children belong to the nearest row that stays; names are gathered from the leaves
inside; what is left is numbered anew, function by function. Windows over each file's rows in pre-order do all of it; rows are
dealt by file once. Documents that are still XML are contracted where they are parsed, node by node, with the same rules: a
document is whole there, so its nodes are neither sorted nor sent anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EXPRS
from ..sources.xml_trees import ROWS, parse
from .intervals import with_level, with_nearest

_NAMES = ("name", "pattern", "self")
_QUOTES = re.compile("^[\"'`]|[\"'`]$")
_NAMELESS = ("literal", "binary", "unary", "block", "if", "case", "try", "ternary", "while", "list", "tuple", "record")


def _with_rules(trees: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of (tag, field), else that of any tag with the field, else that of the tag; people write the table, so it is broadcast."""
    found = trees
    for k, on in (("r1", ["language", "tag", "field"]), ("r2", ["language", "field"]), ("r3", ["language", "tag"])):
        own = rules.where({"r1": "field IS NOT NULL AND tag <> '*'", "r2": "field IS NOT NULL AND tag = '*'", "r3": "field IS NULL"}[k])
        own = own.groupBy(*on).agg(F.first(F.struct("kind", "role", "literal_kind")).alias(k))
        found = found.join(F.broadcast(own), on, "left")
    return found.withColumn("rule", F.coalesce("r1", "r2", "r3")).drop("r1", "r2", "r3")


def expressions(trees: DataFrame, rules: DataFrame) -> DataFrame:
    """schema.EXPRS of trees(language, file, node_id, pre_order, subtree_end, tag, field, text, line) as sources.xml_trees reads them.

    A function outside of all functions begins a tree of its own, called name@node_id; rows outside are in the tree "" of their file. What a
    name is reached through, such as the call in ``f(x).g``, has child_ix -1. Files without nodes give no rows.
    """
    t = trees.where("node_id IS NOT NULL").select("language", "file", "node_id", "pre_order", "subtree_end", "tag", "field", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("line", F.lit(0)).alias("line")).repartition("file")
    t = _with_rules(t, rules)
    leaf = F.col("pre_order") == F.col("subtree_end")
    kind = F.when(F.col("rule").isNull() & leaf & (F.col("text") != ""), "var").otherwise(F.col("rule.kind"))
    t = t.withColumns({"kind": kind, "role": F.col("rule.role"), "literal_kind": F.col("rule.literal_kind")}).drop("rule")
    t = with_level(t, ["file"], F.col("role") == "drop", "drop").where("drop_level = 0 AND (role IS NULL OR role <> 'drop')")
    names = F.col("role").isin(*_NAMES)
    t = with_nearest(t, ["file"], F.col("kind").isNotNull() | names | (F.col("role") == "params"), "m", [F.col("role")])
    t = t.withColumn("kind", F.when((F.col("kind") == "var") & (F.col("m.role") == "params"), "param").otherwise(F.col("kind")))
    inside = F.coalesce(F.col("m.role").isin(*_NAMES), F.lit(False))
    consumed = (F.col("kind").isin("var", "field") & inside) | F.coalesce(F.col("m.role") == "pattern", F.lit(False))
    t = t.withColumn("kept", F.col("kind").isNotNull() & ~consumed)
    t = with_nearest(t, ["file"], F.col("kept"), "k", [F.col("node_id")])
    # leaves whose text is part of a name, for the nearest row that stays
    part = t.where(leaf & (F.col("text") != "") & ~F.col("kept") & (inside | F.coalesce(names, F.lit(False))))
    own = F.coalesce(F.when(F.col("role") == "pattern", F.col("role")), F.when(F.col("m.role") == "pattern", F.col("m.role")), F.lit("name"))
    named = part.select("file", F.col("k.node_id").alias("node_id"), F.struct("pre_order", "text", own.alias("role")).alias("p")).groupBy("file", "node_id").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    pattern = F.filter("parts", lambda p: p["role"] == "pattern")
    joined = F.when(F.size(pattern) > 1, "_").when(F.size(pattern) == 1, pattern[0]["text"]).otherwise(F.array_join(F.transform("parts", lambda p: p["text"]), "."))
    rows = t.where("kept").join(named.select("file", "node_id", joined.alias("named")), ["file", "node_id"], "left")
    text = F.regexp_replace("text", "^[\"'`]|[\"'`]$", "")
    rows = rows.withColumns(
        {
            "name": F.when(F.col("kind").isin(*_NAMELESS), "").otherwise(F.coalesce("named", "text")),
            "literal": F.when(F.col("kind") == "literal", F.coalesce("named", text)),
            "op": F.when(F.col("kind").isin("binary", "unary"), F.when(F.col("tag") == "template_string", "interpolation").otherwise(F.col("text"))),
            "receiver": inside,
        }
    )
    # trees: the outermost function around a row, or that it is
    rows = with_level(rows, ["file"], F.col("kind") == "function", "f")
    outermost = (F.col("kind") == "function") & (F.col("f_level") == 0)
    upto = Window.partitionBy("file").orderBy("pre_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("fn", F.last(F.when(outermost, F.struct("name", "node_id", "k_level")), ignorenulls=True).over(upto))
    here = outermost | (F.col("f_level") > 0)
    rows = rows.withColumns({"fn_id": F.when(here, F.concat("fn.name", F.lit("@"), "fn.node_id")).otherwise(""), "depth": F.col("k_level") - F.when(here, F.col("fn.k_level")).otherwise(0)})
    rows = rows.select("file", "fn_id", "pre_order", "subtree_end", "kind", "name", "literal_kind", "literal", "op", "line", "depth", "receiver")
    by_tree = Window.partitionBy("file", "fn_id")
    rows = rows.withColumn("expr_id", F.row_number().over(by_tree.orderBy("pre_order")).cast("long") - 1)
    rows = with_nearest(rows, ["file", "fn_id"], F.lit(True), "p", [F.col("expr_id")]).withColumn("parent_id", F.col("p.expr_id")).drop("p", "p_level")
    siblings = Window.partitionBy("file", "fn_id", "parent_id").orderBy("pre_order")
    rows = rows.withColumn("child_ix", F.when(F.col("receiver"), -1).otherwise(F.sum((~F.col("receiver")).cast("int")).over(siblings) - 1).cast("int"))
    # a subtree's end: how many rows have begun when it ends
    ends = F.explode(F.array(F.struct((F.col("pre_order") * 2).alias("at"), F.lit(1).alias("n")), F.struct((F.col("subtree_end") * 2 + 1).alias("at"), F.lit(0).alias("n"))))
    begun = rows.withColumn("_e", ends).withColumn("begun", F.sum("_e.n").over(by_tree.orderBy("_e.at").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_e.n = 0")
    out = begun.withColumns({"pre_order": F.col("expr_id"), "subtree_end": F.col("begun") - 1})
    return out.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in EXPRS.split(", ")])


def _named(parts: list[tuple[str, bool]], text: str) -> str:
    """A name from the leaves inside, (text, whether it is a pattern's), else the row's own text."""
    pattern = [x for x, p in parts if p]
    return "_" if len(pattern) > 1 else pattern[0] if pattern else ".".join(x for x, _ in parts) if parts else text


def _resolved(tag: str, field: str | None, rules: tuple[dict, dict, dict]) -> tuple:
    """What the rules say of a node: its tag, whether a rule fits, kind, role, literal kind, whether it is part of a name, whether it counts."""
    exact, by_field, by_tag = rules
    rule = by_tag.get(tag) if field is None else exact.get((tag, field)) or by_field.get(field) or by_tag.get(tag)
    kind, role, literal_kind = rule or (None, None, None)
    return tag, rule is not None, kind, role, literal_kind, role in _NAMES, kind is not None or role in _NAMES or role == "params"


def _contract(nodes: list) -> list[tuple]:
    """What expressions() makes of one document's nodes (parent, _resolved, text, line, whether it has no children), without its file: one pass down, one back up."""
    below: list = []  # by node, for its children: dropped, role of the nearest row that counts, nearest row that stays, rows that stay, tree
    # a row: 0 children with a place, 1 end, 2 number, 3 row above, 4 place, 5 kind, 6 literal kind, 7 text, 8 tag, 9 line, 10 depth, 11 leaves of its name, 12 tree
    rows: list[list] = []
    # a tree: 0 children with a place, 1 rows, 2 its function's row, 3 level, 4 node
    outside: list = [0, 0, None, 0, -1]
    top = (False, None, None, 0, outside)
    for parent, (tag, fits, kind, role, literal_kind, names, counts), text, line, leaf in nodes:
        dropped, m, up, level, tree = top if parent is None else below[parent]
        if dropped or role == "drop":
            below.append((True, m, up, level, tree))
            continue
        if text:
            text = text.strip()
            if not fits and leaf and text:
                kind, counts = "var", True
        inside = m in _NAMES
        if kind is not None:
            if kind == "var" and m == "params":
                kind = "param"
            if m != "pattern" and not (inside and kind in ("var", "field")):
                outermost = kind == "function" and tree is outside
                if outermost:
                    tree = [0, 0, None, level, len(below)]
                above = tree if up is None or outermost else up
                n = tree[1]
                r = [0, n, n, None if above is tree else above, -1 if inside else above[0], kind, literal_kind, text, tag, line, level - tree[3], None, tree]
                tree[1] = n + 1
                if not inside:
                    above[0] += 1
                if outermost:
                    tree[2] = r
                rows.append(r)
                below.append((False, role, r, level + 1, tree))
                continue
        if leaf and text and up is not None and (inside or names):
            part = (text, role == "pattern" or m == "pattern")
            if up[11] is None:
                up[11] = [part]
            else:
                up[11].append(part)
        below.append((False, role if counts else m, up, level, tree))
    for r in reversed(rows):
        up = r[3]
        if up is not None and up[1] < r[1]:
            up[1] = r[1]
    out, names = [], {}
    for _, end, n, up, ix, kind, literal_kind, text, tag, line, depth, parts, tree in rows:
        if tree is outside:
            fn = ""
        else:
            fn = names.get(tree[4])
            if fn is None:
                fn = names[tree[4]] = f"{_named(tree[2][11] or (), tree[2][7])}@{tree[4]}"
        literal = op = None
        if kind in _NAMELESS:
            name = ""
            if kind == "literal":
                literal = _named(parts, text) if parts else _QUOTES.sub("", text)
            elif kind == "binary" or kind == "unary":
                op = "interpolation" if tag == "template_string" else text
        else:
            name = _named(parts, text) if parts else text
        out.append((fn, n, None if up is None else up[2], ix, kind, name, literal_kind, literal, op, line, depth, n, end))
    return out


_ATTRIBUTE = r"""[ \t\n]+([A-Za-z_][A-Za-z0-9_.-]*)=("[^"&\t\n]*"|'[^'&\t\n]*')"""
_START = re.compile(rf"([A-Za-z_][A-Za-z0-9_.-]*)((?:{_ATTRIBUTE})*)[ \t\n]*(/?)")
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_END = re.compile(r"/([A-Za-z_][A-Za-z0-9_.-]*)[ \t\n]*")
#: Signs that only the XML reader judges.
_ODD = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff\ufeff\ufffe\uffff]")
#: Tags that are remembered, at most, and how long they and the text behind them may be; this only saves time.
TAGS, LONG = 65_536, 96


def _tag(inside: str, rules: tuple[dict, dict, dict]) -> tuple | None:
    """What stands between < and >: whether it ends an element, its name, whether it also ends what it begins, what the rules say of it, its line, no text. None: not plain."""
    end = _END.fullmatch(inside)
    if end:
        return True, end[1], False, None, 0, ""
    start = _START.fullmatch(inside)
    if not start:
        return None
    found = _ATTRIBUTES.findall(start[2])
    own = {k: v[1:-1] for k, v in found}
    if len(own) < len(found):
        return None
    line = own.get("srow", "")
    return False, start[1], inside[-1] == "/", _resolved(start[1], own.get("field"), rules), int(line) + 1 if line.isdecimal() else 0, ""


def _behind(piece: str, rules: tuple[dict, dict, dict], known: dict[str, tuple]) -> tuple | None:
    """_tag of what stands behind a <, with the text up to the next; both are remembered."""
    inside, closed, after = piece.partition(">")
    tag = known.get(inside + ">") or (_tag(inside, rules) if closed else None)
    if tag is None:
        return None
    if len(piece) <= LONG:
        if len(known) >= TAGS - 1:
            known.clear()
        known[inside + ">"] = tag
        known[piece] = (*tag[:5], after)
    return *tag[:5], after


def _plain_nodes(text: str, rules: tuple[dict, dict, dict], known: dict[str, tuple]) -> list[list] | None:
    """Nodes of a well-formed document of tags, attributes and texts only; None for any other, the XML reader has to look at it."""
    if "&" in text or "<!" in text or "<?" in text or "]]>" in text or not (text.isprintable() or _ODD.search(text) is None):
        return None
    pieces = text.split("<")
    if pieces[0].strip(" \t\n"):
        return None
    nodes: list[list] = []
    open_: list[tuple[int, str]] = []
    for piece in pieces[1:]:
        tag = known.get(piece) or _behind(piece, rules, known)
        if tag is None:
            return None
        ends, name, both, resolved, line, after = tag
        if ends:
            if not open_ or open_.pop()[1] != name:
                return None
        else:
            if open_:
                parent = open_[-1][0]
                nodes[parent][4] = False
            elif nodes:
                return None
            else:
                parent = None
            if not both:
                open_.append((len(nodes), name))
                nodes.append([parent, resolved, after, line, True])
                continue
            nodes.append([parent, resolved, "", line, True])
        if after:  # what follows an element is its parent's
            if open_:
                nodes[open_[-1][0]][2] += after
            elif after.strip(" \t\n"):
                return None
    return None if open_ or not nodes else nodes


def _document_nodes(text: str | None, rules: tuple[dict, dict, dict], known: dict[str, tuple]) -> list:
    """Nodes of a document as _contract takes them; ``known`` holds the tags that were met before under the same rules."""
    found = _plain_nodes(text, rules, known) if text else None
    if found is None:
        found = [(up, _resolved(tag, field, rules), own, line or 0, at == end) for at, up, _, _, _, end, tag, field, own, line, *_ in parse(text)[0]]
    return found


def _held(rules: DataFrame) -> dict[str, tuple[dict, dict, dict]]:
    """The rules that people write as three dictionaries a language: by tag and field, by field, by tag."""
    held: dict[str, tuple[dict, dict, dict]] = {}
    for r in rules.select("language", "tag", "field", "kind", "role", "literal_kind").collect():
        exact, by_field, by_tag = held.setdefault(r["language"], ({}, {}, {}))
        table, key = (by_tag, r["tag"]) if r["field"] is None else (by_field, r["field"]) if r["tag"] == "*" else (exact, (r["tag"], r["field"]))
        table.setdefault(key, (r["kind"], r["role"], r["literal_kind"]))
    return held


_ARROW = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def by_document(documents: DataFrame, rules: DataFrame, found: Callable[[str, str, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``found(file, language, rows)`` makes of each document's expression rows, in the task that parses it; nothing is shuffled.

    ``rows`` are schema.EXPRS without the file, in the order of the document. ``documents`` has file, content and language. Rules are a table
    that people write; the tasks get them as dictionaries.
    """
    held = _held(rules)
    columns = [(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])

    def run(batches):
        rows, none, known = [], ({}, {}, {}), {language: {} for language in (*held, None)}
        for b in batches:
            for file, body, language in zip(*(c.to_pylist() for c in b.columns), strict=True):
                language_rules = held.get(language, none)
                rows += found(file, language, _contract(_document_nodes(body, language_rules, known[language if language in held else None])))
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return documents.selectExpr("cast(file AS string) AS file", "cast(content AS string) AS content", "language").mapInArrow(run, schema)


def document_expressions(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """schema.EXPRS and language of documents(file, content, language): xml_trees and expressions in one task, nothing is shuffled."""
    return by_document(documents, rules, lambda file, language, rows: [(file, *r, language) for r in rows], f"{EXPRS}, language string")
