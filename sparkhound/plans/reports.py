"""Findings as JSON, SARIF, Markdown, DOT, terminal text and rule lists, as strings for people: they collect what they show.

``report_files`` writes the same documents from the tasks, whatever their size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

# SARIF levels.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
# Colours of call graph nodes by class.
COLOURS = {"Entry": "green", "Sink": "red", "Reachable": "orange", "Dormant": "gray"}


def finding_json(found: DataFrame) -> DataFrame:
    """(json): one object a finding; dependency, reachability and suggestion only where set (K-06)."""
    return found.select(finding_object(found).alias("json"))


def finding_object(found: DataFrame) -> Column:
    """The JSON object of a row of ``found``."""
    cols = [c for c in ("rule", "severity", "file", "line", "message", "flow", "dependency", "reachability", "suggestion") if c in found.columns]
    return F.to_json(F.struct(*cols))


def json_report(found: DataFrame, files: int) -> str:
    """The report envelope: counts by label, then findings by severity, file and line (K-02)."""
    rows = _ordered(found)
    counts = {r["label"]: r["n"] for r in found.groupBy(P.severity_label(F.col("severity")).alias("label")).agg(F.count("*").alias("n")).collect()}
    return json.dumps({"files_scanned": files, "summary": {k: counts.get(k, 0) for k in ("Error", "Warning", "Info")}, "findings": rows}, ensure_ascii=False)


def _ordered(found: DataFrame, limit: int | None = None) -> list[dict]:
    cols = [c for c in ("rule", "severity", "file", "line", "message", "flow", "dependency", "reachability", "suggestion") if c in found.columns]
    sorted_ = found.orderBy(F.desc(P.severity_rank(F.col("severity"))), "file", "line", "rule").select(*cols)
    rows = (sorted_ if limit is None else sorted_.limit(limit)).collect()
    keep = {"rule", "severity", "file", "line", "message", "flow"}
    return [{k: v for k, v in r.asDict(recursive=True).items() if k in keep or v is not None} for r in rows]


def _reached(reach: dict) -> dict:
    """A finding's reachability as properties; the way from the entry point as places."""
    out = {"status": reach["status"]}
    if reach.get("entry_function"):
        out |= {"entryPoint": reach.get("entry_point"), "entryFunction": reach["entry_function"], "pathLength": reach.get("path_length"), "path": [f"{p['file']}:{p['line']}" for p in reach.get("path") or []]}
    return {"reachability": out}


def supply_chain(audited: DataFrame, advisories: DataFrame | None = None) -> str:
    """JSON of audited dependencies, worst first, each with its advisories (K-09)."""
    rows = audited.orderBy(F.expr("CASE level WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"), "name").collect()
    known: dict[str, list] = {}
    if advisories is not None:
        for a in advisories.where("NOT failed").orderBy("name", "id").collect():
            known.setdefault(a["name"], []).append({"id": a["id"], "summary": a["summary"], "severity": a["severity"]})
    out = [{"name": r["name"], "version": r["version"], "level": r["level"], "vulnerabilities": r["n_vulns"], "advisories": known.get(r["name"], [])} for r in rows]
    counts = {level: sum(r["level"] == level for r in rows) for level in ("critical", "warning", "clean")}
    return json.dumps({"summary": counts, "dependencies": out}, ensure_ascii=False)


def sarif(found: DataFrame, tool: str = "sparkhound", version: str = "1.0", audited: DataFrame | None = None) -> str:
    """SARIF 2.1.0 with each rule once, code flows and reachability where known, and dependencies that are not clean (K-03)."""
    rows = _ordered(found)
    place = lambda file, line: {"physicalLocation": {"artifactLocation": {"uri": file}, "region": {"startLine": max(1, line or 1)}}}
    results = []
    for r in rows:
        out = {"ruleId": r["rule"], "level": LEVELS.get(r["severity"].lower(), "note"), "message": {"text": r["message"]}, "locations": [place(r["file"], r["line"])]}
        if r.get("flow"):
            steps = [{"location": {**place(s["file"], s["line"]), "message": {"text": s["message"]}}} for s in r["flow"]]
            out["codeFlows"] = [{"threadFlows": [{"locations": steps}]}]
        if r.get("reachability"):
            out["properties"] = _reached(r["reachability"])
        results.append(out)
    for d in audited.where("level <> 'clean'").orderBy("name").collect() if audited is not None else []:
        text = f"{d['name']} {d['version'] or ''}".strip() + f" is {d['level']}, {d['n_vulns']} known vulnerabilities"
        results.append({"ruleId": "dependency", "level": "error" if d["level"] == "critical" else "warning", "message": {"text": text}})
    rules = [{"id": x} for x in dict.fromkeys(r["ruleId"] for r in results)]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, ensure_ascii=False)


def markdown(found: DataFrame) -> str:
    """One section a finding (K-04)."""
    parts = ["# Findings", ""]
    for r in _ordered(found):
        parts += [f"## {r['rule']} ({r['severity']})", "", f"`{r['file']}:{r['line']}`", "", r["message"], ""]
        parts += [f"{k}. `{s['file']}:{s['line']}` {s['message']}" for k, s in enumerate(r.get("flow") or [], 1)]
        if r.get("suggestion"):
            parts += [f"Fix: `{r['suggestion']}`", ""]
    return "\n".join(parts)


def terminal(found: DataFrame, limit: int = 1000) -> tuple[str, int]:
    """(text, exit code): the gravest ``limit`` findings, which is what a terminal can show, and the number of all; 1 if there are any (K-01)."""
    total = found.count()
    lines = [f"[{r['severity']}] {r['rule']} {r['file']}:{r['line']} {r['message']}" for r in _ordered(found, limit)]
    more = [f"{total - len(lines)} more"] if total > len(lines) else []
    return "\n".join([*lines, *more, f"{total} findings"]), int(total > 0)


def dot(edges: DataFrame, classes: DataFrame) -> str:
    """The call graph; colours by class (K-05)."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    nodes = [f"  {quote(r['name'])} [color={COLOURS[r['class']]}];" for r in classes.orderBy("name").collect()]
    links = [f"  {quote(r['caller'])} -> {quote(r['callee'])};" for r in edges.select("caller", "callee").distinct().orderBy("caller", "callee").collect()]
    return "\n".join(["digraph calls {", *nodes, *links, "}"])


def rule_list(sinks: DataFrame) -> str:
    """Rules with their sinks as JSON (K-07), and counts by severity (A-14)."""
    rows = sinks.groupBy("rule", "severity").agg(F.sort_array(F.collect_list("pattern")).alias("sinks")).orderBy("rule").collect()
    counts = {r["severity"]: r["n"] for r in sinks.select("rule", "severity").distinct().groupBy("severity").agg(F.count("*").alias("n")).collect()}
    return json.dumps({"rules": [r.asDict() for r in rows], "by_severity": counts})


def bar(live: int, total: int, width: int = 10) -> str:
    """A heat bar of the live share."""
    full = round(width * live / total) if total else 0
    return "#" * full + "." * (width - full)
