"""Predicates over node columns, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

def any_prefix(column: Column, words: list[str]) -> Column:
    """Whether the text starts with one of the words (F-01)."""
    return column.rlike("^(?:" + "|".join(map(re.escape, words)) + ")") if words else F.lit(False)


def any_substring(column: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words (F-02)."""
    return column.rlike("(?:" + "|".join(map(re.escape, words)) + ")") if words else F.lit(False)


def any_suffix(column: Column, words: list[str]) -> Column:
    return column.rlike("(?:" + "|".join(map(re.escape, words)) + ")$") if words else F.lit(False)


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def first_segment(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def is_string_method(name: Column) -> Column:
    """Methods whose result keeps their receiver's taint, also in their ``!`` form (F-03)."""
    return F.regexp_replace(last_segment(name), "!$", "").isin(*W.STRING_METHODS)


def word_bounded(column: Column, words: list[str]) -> Column:
    """A word between spaces, dots, underscores, an opening bracket or the ends."""
    return column.rlike(r"(?:^|[ ._])(?:" + "|".join(map(re.escape, words)) + r")(?:$|[ ._(])")


def entry_kind(name: Column, args: Column, custom: list[str] | None = None) -> Column:
    """"http", "cli", "custom" or null; in this order of preference (F-06)."""
    http = F.exists(args, lambda a: any_prefix(a["value"], W.HTTP_PARAMS)) | any_prefix(name, W.HTTP_FUNCTIONS)
    cli = name.isin(*W.CLI_FUNCTIONS) | F.exists(args, lambda a: a["value"].isin(*W.CLI_PARAMS))
    return F.when(http, "http").when(cli, "cli").when(any_prefix(name, custom or []), "custom")


def auth_guard(name: Column) -> Column:
    """A call that proves who is asking (F-05)."""
    return any_substring(name, W.AUTH_WORDS)


def value_check(name: Column) -> Column:
    """A call that checks a value (F-05)."""
    named = name.rlike("^[a-z]") & any_substring(name, W.VALID_WORDS)
    return any_suffix(name, W.VALID_SUFFIXES) | named | any_suffix(name, W.SCHEME_SUFFIXES) | (name == "=~") | name.endswith(".match")


def flag_name(name: Column) -> Column:
    low = F.lower(name)
    return any_prefix(low, W.FLAG_PREFIXES) | low.isin(*W.FLAG_NAMES)


def args_contain(args: Column, words: Column) -> Column:
    """Some argument's value holds some of the words (F-10)."""
    return F.exists(args, lambda a: F.exists(words, lambda w: F.contains(a["value"], w)))


def args_missing(args: Column, words: Column) -> Column:
    """There are arguments and none holds any of the words (F-10)."""
    return (F.size(args) > 0) & ~args_contain(args, words)


def all_literal(args: Column) -> Column:
    """No arguments is not all-literal (F-11)."""
    return (F.size(args) > 0) & F.forall(args, lambda a: a["arg_type"] == "literal")


def secret_literal(value: Column) -> Column:
    """A known prefix and at least 20 characters (F-20)."""
    return (F.length(value) >= 20) & any_prefix(value, W.SECRET_PREFIXES)


def address_literal(value: Column) -> Column:
    """A URL scheme or four dotted numbers; loopback is exempt (F-21)."""
    return value.rlike(r"^(?:https?|ftp|wss?)://|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & ~value.rlike(r"^(?:https?://)?(?:localhost|127\.0\.0\.1|0\.0\.0\.0)")


def severity_label(severity: Column) -> Column:
    """Critical and high are errors, medium and low warnings, the rest information (F-23)."""
    s = F.lower(severity)
    return F.when(s.isin("critical", "high"), "Error").when(s.isin("medium", "low"), "Warning").otherwise("Info")


def severity_rank(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "critical", 4).when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def glob_to_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` do not (F-16)."""
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif glob.startswith("**", k):
            out.append(".*")
            k += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])))
            k += 1
    return "^" + "".join(out) + "$"


def suppressed(rule: Column, file: Column, patterns: dict[str, list[str]]) -> Column:
    """Findings named by rule id, or by rule id and a file glob; no globs means everywhere (F-17)."""
    out = F.lit(False)
    for name, globs in patterns.items():
        here = F.lit(True) if not globs else file.rlike("|".join(map(glob_to_regex, globs)))
        out = out | (rule == name) & here
    return out


def test_file(file: Column) -> Column:
    """Tests, specs, benchmarks and examples by their path (F-18)."""
    return file.rlike(r"(?:^|/)(?:tests?|spec|specs|bench|benchmarks?|examples?)/|(?:_test|_spec|\.test|\.spec|_bench)\.[A-Za-z0-9]+$|(?:^|/)test_[^/]*$")
