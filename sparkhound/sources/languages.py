"""Languages as rows of a registry: what the readers and operators need to know of each, and how a project adds its own (2.13)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from . import return_types, tree_rules
from .project import language as by_extension


@dataclass(frozen=True)
class Language:
    """``extensions`` without dots; ``rules`` as in sources.tree_rules; ``suffixes`` as in functions.words.IMPORT_SUFFIXES; ``returns`` by kind, as in sources.return_types."""

    name: str
    extensions: tuple[str, ...] = ()
    rules: tuple[tuple, ...] = ()
    suffixes: tuple[str, ...] = ("",)
    returns: dict[str, list[str]] = field(default_factory=dict)


def shipped() -> dict[str, Language]:
    """The languages that come with the library; their extensions are those of sources.project."""
    names = dict.fromkeys([*tree_rules.LANGUAGES, *W.IMPORT_SUFFIXES, "crystal", "gleam"])
    known = {"crystal": return_types.CRYSTAL, "gleam": return_types.GLEAM}
    return {n: Language(n, (), tuple(tree_rules.LANGUAGES.get(n, ())), W.IMPORT_SUFFIXES.get(n, ("",)), known.get(n, {})) for n in names}


class Registry:
    """Languages by name; a language that is added later takes the place of one of the same name."""

    def __init__(self, *more: Language):
        self.languages = shipped() | {x.name: x for x in more}

    def of(self, path: Column) -> Column:
        """A path's language: that of a registered extension, else that of the library's table."""
        end = F.substring_index(path, ".", -1)
        own = [(e, x.name) for x in self.languages.values() for e in x.extensions]
        found = None
        for extension, name in own:
            found = F.when(end == extension, name) if found is None else found.when(end == extension, name)
        return by_extension(path) if found is None else F.coalesce(found, by_extension(path))

    def tree_rules(self, spark: SparkSession) -> DataFrame:
        return tree_rules.tree_rules(spark, {n: list(x.rules) for n, x in self.languages.items()})

    def return_types(self, spark: SparkSession) -> DataFrame:
        return return_types.return_types(spark, {n: x.returns for n, x in self.languages.items() if x.returns})

    def import_suffixes(self) -> dict[str, tuple[str, ...]]:
        return {n: x.suffixes for n, x in self.languages.items()}
