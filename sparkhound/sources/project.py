"""Project files: discovery, configuration, manifests, advisories, caches."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = {
    "cr": "crystal", "gleam": "gleam", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "svelte": "svelte", "ml": "ocaml", "rs": "rust",
    "ex": "elixir", "exs": "elixir", "fs": "fsharp", "nim": "nim",
}
ALWAYS_EXCLUDED = ["obj", "bin"]
ROOT_EXCLUDED = ["node_modules", "_build", "build", "dist", "target", "deps", "vendor", "coverage"]
#: A project with one of these keeps its dependencies in lib.
SHARD_MANIFESTS = ["shard.yml"]
CAP = 16 * 1024 * 1024


def language(path: Column) -> Column:
    """By extension; null for others (S-04)."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def discover(spark: SparkSession, root: str, langs: list[str] | None = None, include_deps: bool = False, cap: int = CAP) -> DataFrame:
    """(path, lang, is_dependency, dependency_name, content) of source files under a folder, by path (S-01..S-04, S-07).

    Dot entries and excluded folders are left out; a project with a shard manifest keeps its ``lib`` apart.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit("/" + root.rstrip("/").rsplit("/", 1)[-1] + "/")
    rel = F.substring_index("path", base, -1) if not re.match(r"^\w+://|^/", root) else F.expr(f"substring(path, instr(path, '{root.rstrip('/')}') + {len(root.rstrip('/')) + 1})")
    parts = F.split("rel", "/")
    manifest = not files.withColumn("rel", rel).where(F.col("rel").isin(*SHARD_MANIFESTS)).select("rel").isEmpty()
    is_dep = (F.element_at(parts, 1) == "lib") & F.lit(manifest)
    out = files.withColumn("rel", rel).where(F.col("length") <= cap).where(~F.col("rel").rlike(r"(?:^|/)\.|\.svelte\.ts$"))
    out = out.where(~F.exists(parts, lambda p: p.isin(*ALWAYS_EXCLUDED)) & ~F.element_at(parts, 1).isin(*ROOT_EXCLUDED)).withColumn("lang", language(F.col("rel"))).where("lang IS NOT NULL")
    out = out.select(F.col("rel").alias("path"), "lang", is_dep.alias("is_dependency"), F.when(is_dep, F.element_at(parts, 2)).alias("dependency_name"), "content")
    if not include_deps:
        out = out.where("NOT is_dependency")
    return (out.where(F.col("lang").isin(*langs)) if langs else out).orderBy("path")


def language_counts(files: DataFrame) -> DataFrame:
    """(lang, n): source files by language, most first (A-13)."""
    return files.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


def fingerprint(content: Column, schema: int = 1) -> Column:
    """A cache key that a new schema version invalidates (S-20)."""
    return F.concat(F.lit(f"v{schema}:"), F.md5(content))


DEFAULTS = {"scan": {"path": ".", "languages": [], "exclude": []}, "analysis": {"cfg": False, "reachability": False, "extra_sources": []}, "claws": {"enabled": False}, "suppress": {}}


def load_config(text: str, overrides: dict | None = None) -> dict:
    """TOML over the defaults, then overrides; ``*.suppress`` tables map rules to globs (S-16)."""
    given = tomllib.loads(text)
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    for section, values in [*given.items(), *(overrides or {}).items()]:
        if not isinstance(values, dict):
            continue
        for k, v in values.items():
            if k == "suppress" and isinstance(v, dict):
                out["suppress"] |= {r: [g] if isinstance(g, str) else list(g) for r, g in v.items()}
            else:
                out.setdefault(section, {})[k] = v
    return out


def find_config(start: str, name: str) -> str | None:
    """The nearest file of a name in a folder or above it."""
    here = Path(start).resolve()
    return next((str(p / name) for p in (here, *here.parents) if (p / name).is_file()), None)


def shard_manifest(text: str) -> list[tuple[str, str | None, str | None]]:
    """(name, source, version) of a shard-like YAML manifest's dependencies (S-17)."""
    out, section, name, fields = [], None, None, {}
    for line in [*text.splitlines(), "end:"]:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        key, _, val = line.strip().partition(":")
        if depth <= 2 and name:
            out.append((name, fields.get("github") or fields.get("git"), fields.get("version")))
            name, fields = None, {}
        if depth == 0:
            section = key
        elif section in ("dependencies", "development_dependencies"):
            if depth == 2:
                name = key
            else:
                fields[key] = val.strip().strip("\"'")
    return out


def hex_manifest(text: str) -> list[tuple[str, str | None, str | None]]:
    given = tomllib.loads(text)
    return [(n, "hex", v if isinstance(v, str) else None) for s in ("dependencies", "dev-dependencies") for n, v in given.get(s, {}).items()]


def nimble_manifest(text: str) -> list[tuple[str, str | None, str | None]]:
    """Bare names, constraints and URLs in requires lines."""
    out = []
    for spec in re.findall(r'"([^"]+)"', "\n".join(x for x in text.splitlines() if x.strip().startswith("requires"))):
        if "://" in spec:
            out.append((spec.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"), spec, None))
        elif spec.split()[0] != "nim":
            m = re.match(r"(\S+)\s*(?:(?:>=|==|~=|\^=|>)\s*)?([0-9][^\s]*)?", spec)
            out.append((m[1], None, m[2]))
    return out


def nimble_lock(text: str) -> list[tuple[str, str | None, str | None]]:
    return [(n, p.get("url"), p.get("version")) for n, p in json.loads(text).get("packages", {}).items()]


ADVISORY = "vulns array<struct<id:string,summary:string,severity:string,database_specific:struct<severity:string>>>"


def advisories(responses: DataFrame) -> DataFrame:
    """(name, id, summary, severity, failed) from (name, body): advisory JSON; a null or broken body is a failed query (S-18)."""
    parsed = responses.select("name", "body", F.from_json("body", ADVISORY).alias("j"))
    good = parsed.where("j.vulns IS NOT NULL").select("name", F.explode("j.vulns").alias("v"))
    hits = good.select("name", "v.id", "v.summary", F.coalesce("v.database_specific.severity", "v.severity", F.lit("unknown")).alias("severity"), F.lit(False).alias("failed"))
    bad = parsed.where("body IS NULL OR j IS NULL").select("name", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("summary"), F.lit("").alias("severity"), F.lit(True).alias("failed"))
    return hits.unionByName(bad)


MODULE = (
    "file string, module string, functions array<struct<name:string,arity:int,line:int,params:array<string>,calls:array<struct<name:string,line:int,args:array<string>>>>>"
)


def elixir_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes from module JSON: a definition for each function, then its calls (S-23)."""
    m = spark.read.schema(MODULE).json(path)
    fn = m.select("file", F.posexplode("functions").alias("i", "f"))
    arg = lambda kind: (lambda v: F.struct(F.lit(kind).alias("arg_type"), v.alias("value"), F.lit("").alias("field")))
    defs = fn.select("file", (F.col("i") * 100_000).cast("bigint").alias("ord"), "f.line", F.lit("def").alias("node_type"), "f.name", F.transform("f.params", arg("var")).alias("args"))
    calls = fn.select("file", "i", F.posexplode("f.calls").alias("k", "c")).select("file", (F.col("i") * 100_000 + F.col("k") + 1).cast("bigint").alias("ord"), "c.line", F.lit("call").alias("node_type"), "c.name", F.transform("c.args", arg("var")).alias("args"))
    return defs.unionByName(calls).select("file", "ord", "line", "node_type", "name", "args", F.lit(False).alias("taint"), F.lit("elixir").alias("language"), F.create_map().cast("map<string,string>").alias("metadata"))
