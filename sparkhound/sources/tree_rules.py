"""How the syntax trees of a language become expression rows: one row for each tag, or tag and field, that means something.

role: "name" and "pattern" give the texts inside to the expression around (a pattern of several names gives "_"), "self" gives
them to the row itself, "params" makes the variables inside parameters, "drop" leaves the subtree out. A tag without a row is a wrapper: its children belong to what is around
it; a leaf of that sort that has a text is a variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULES = "language string, tag string, field string, kind string, role string, literal_kind string"

#: Tags and fields of the languages' public grammars. (tag, field, kind, role, literal kind)
GLEAM = [
    ("function", None, "function", None, None),
    ("function_parameter", None, "param", None, None),
    ("identifier", "name", None, "name", None),
    ("identifier", None, "var", None, None),
    ("constructor_name", None, "var", None, None),
    ("label", None, None, "name", None),
    ("field_access", None, "field", "self", None),
    ("function_call", None, "app", None, None),
    ("*", "function", None, "name", None),
    ("record", None, "app", None, None),
    ("constructor_name", "name", None, "name", None),
    ("tuple", None, "tuple", None, None),
    ("list", None, "list", None, None),
    ("anonymous_function", None, "lambda", None, None),
    ("parameter", None, "param", None, None),
    ("let", None, "let", None, None),
    ("assignment", None, "let", None, None),
    ("use", None, "let", None, None),
    ("*", "pattern", None, "pattern", None),
    ("use_assignment", None, None, "pattern", None),
    ("if", None, "if", None, None),
    ("case", None, "case", None, None),
    ("case_clause", None, "block", None, None),
    ("case_clause_patterns", None, None, "drop", None),
    ("case_clause_guard", None, None, "drop", None),
    ("block", None, "block", None, None),
    ("binary_expression", None, "binary", None, None),
    ("panic", None, "raise", None, None),
    ("todo", None, "raise", None, None),
    ("string", None, "literal", None, "string"),
    ("quoted_content", None, None, "name", None),
    ("integer", None, "literal", None, "int"),
    ("float", None, "literal", None, "float"),
    ("import", None, "import", None, None),
    ("module", None, None, "name", None),
    ("type", None, None, "drop", None),
    ("type_annotation", None, None, "drop", None),
    ("comment", None, None, "drop", None),
    ("ERROR", None, "error", None, None),
]
#: Fixed values, likewise.
JAVASCRIPT = [
    ("function_declaration", None, "function", None, None),
    ("method_definition", None, "function", None, None),
    ("identifier", "name", None, "name", None),
    ("property_identifier", "name", None, "name", None),
    ("property_identifier", "property", None, "name", None),
    ("formal_parameters", None, None, "params", None),
    ("identifier", None, "var", None, None),
    ("member_expression", None, "field", "self", None),
    ("call_expression", None, "app", None, None),
    ("new_expression", None, "app", None, None),
    ("*", "function", None, "name", None),
    ("*", "constructor", None, "name", None),
    ("array", None, "list", None, None),
    ("object", None, "record", None, None),
    ("arrow_function", None, "lambda", None, None),
    ("function_expression", None, "lambda", None, None),
    ("variable_declarator", None, "let", None, None),
    ("object_pattern", "name", None, "pattern", None),
    ("array_pattern", "name", None, "pattern", None),
    ("assignment_expression", None, "assign", None, None),
    ("*", "left", None, "name", None),
    ("if_statement", None, "if", None, None),
    ("ternary_expression", None, "ternary", None, None),
    ("while_statement", None, "while", None, None),
    ("switch_statement", None, "case", None, None),
    ("switch_case", None, "block", None, None),
    ("switch_default", None, "block", None, None),
    ("statement_block", None, "block", None, None),
    ("binary_expression", None, "binary", None, None),
    ("unary_expression", None, "unary", None, None),
    ("template_string", None, "binary", None, None),
    ("string", None, "literal", None, "string"),
    ("string_fragment", None, None, "name", None),
    ("number", None, "literal", None, "int"),
    ("true", None, "literal", None, "bool"),
    ("false", None, "literal", None, "bool"),
    ("null", None, "literal", None, "null"),
    ("return_statement", None, "return", None, None),
    ("throw_statement", None, "raise", None, None),
    ("try_statement", None, "try", None, None),
    ("catch_clause", None, "rescue", None, None),
    ("finally_clause", None, "ensure", None, None),
    ("class_declaration", None, "class", None, None),
    ("import_statement", None, "import", None, None),
    ("string", "source", None, "name", None),
    ("import_clause", None, None, "drop", None),
    ("comment", None, None, "drop", None),
    ("ERROR", None, "error", None, None),
]
LANGUAGES = {"gleam": GLEAM, "javascript": JAVASCRIPT, "typescript": JAVASCRIPT}


def tree_rules(spark: SparkSession, languages: dict[str, list[tuple]] | None = None) -> DataFrame:
    """Rows of RULES; a language that is not here is given as further rows."""
    return spark.createDataFrame([(language, *r) for language, rows in (languages or LANGUAGES).items() for r in rows], RULES)
