"""Rules that hold where a project brings none of its own: the rule files beside this module, one for each language and one for several."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .rules import rule_sources, sink_table

FOLDER = Path(__file__).parent / "rules"


def default_rules_text(*names: str) -> str:
    """The rules in the rule language: of all files, or of those named."""
    return "\n".join((FOLDER / f"{n}.kdl").read_text() for n in names or ("common", "elixir", "javascript", "nim", "ocaml", "rust"))


def default_sinks(spark: SparkSession) -> DataFrame:
    """All rules' sinks, as rows."""
    return sink_table(spark, default_rules_text())


def default_sources() -> list[str]:
    """Names that all rules call sources, once each, in order: for taint.seeds beside its own."""
    return list(dict.fromkeys(name for _, name, _ in rule_sources(default_rules_text())))
