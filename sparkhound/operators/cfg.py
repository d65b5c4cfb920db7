"""Control-flow analysis per function: blocks, dominators, forward may-taint (G-26..G-29).

A function is independent of all others: rows are dealt by function and sorted, and each task walks through its functions one
after the other. Only functions that call something a rule could mean are looked at. Statements after a branch go to the merge
block. A function beyond the documented limit of blocks is reported as skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import large

MAX_BLOCKS = 500

Block = list[dict]


def build_blocks(rows: list[dict], limit: int = MAX_BLOCKS) -> tuple[list[Block], list[set[int]]]:
    """(blocks, successors). Rows have kind: assign, call, branch, else, end, return; branch..[else]..end nest."""
    blocks: list[Block] = [[]]
    succ: list[set[int]] = [set()]

    def new() -> int:
        if len(blocks) >= limit:
            raise OverflowError("too many blocks")
        blocks.append([])
        succ.append(set())
        return len(blocks) - 1

    now, dead, stack = 0, False, []
    for r in rows:
        kind = r["kind"]
        if kind == "branch":
            then = new()
            succ[now].add(then)
            stack.append({"from": now, "ends": [], "else": False})
            now, dead = then, False
        elif kind == "else" and stack:
            top = stack[-1]
            if not dead:
                top["ends"].append(now)
            top["else"], other = True, new()
            succ[top["from"]].add(other)
            now, dead = other, False
        elif kind == "end" and stack:
            top = stack.pop()
            if not dead:
                top["ends"].append(now)
            merge = new()
            for e in top["ends"] + ([] if top["else"] else [top["from"]]):
                succ[e].add(merge)
            now, dead = merge, False
        elif not dead:
            blocks[now].append(r)
            dead = kind == "return"
    while stack:  # a branch that the source never closes ends with the function
        top = stack.pop()
        merge = new()
        for e in [*([] if dead else [now]), *top["ends"], *([] if top["else"] else [top["from"]])]:
            succ[e].add(merge)
        now, dead = merge, False
    return blocks, succ


def predecessors(succ: list[set[int]]) -> list[set[int]]:
    out: list[set[int]] = [set() for _ in succ]
    for a, nexts in enumerate(succ):
        for b in nexts:
            out[b].add(a)
    return out


def dominators(succ: list[set[int]]) -> list[set[int]]:
    """Blocks that every path from the entry to a block passes, itself included; sets are bit fields while they are found."""
    pred, n = predecessors(succ), len(succ)
    every = (1 << n) - 1
    dom = [1, *[every] * (n - 1)]
    changed = True
    while changed:
        changed = False
        for b in range(1, n):
            new = every if pred[b] else 0
            for p in pred[b]:
                new &= dom[p]
            new |= 1 << b
            if new != dom[b]:
                dom[b], changed = new, True
    return [{k for k in range(n) if d >> k & 1} for d in dom]


def _root(name: str) -> str:
    return name.split(".", 1)[0]


def tainted_in(blocks: list[Block], succ: list[set[int]], params: set[str], sources: tuple[str, ...], sanitizers: tuple[str, ...]) -> list[set[str]]:
    """Variables that may be tainted when a block begins: a union over predecessors, to a fixpoint."""
    pred = predecessors(succ)
    start: list[set[str]] = [set() for _ in blocks]
    start[0] = set(params)
    todo, after = list(range(len(blocks))), [set() for _ in blocks]
    while todo:
        b = todo.pop(0)
        start[b] = start[b].union(*(after[p] for p in pred[b])) if pred[b] else start[b]
        out = transfer(blocks[b], set(start[b]), sources, sanitizers)
        if out != after[b]:
            after[b] = out
            todo += [s for s in succ[b] if s not in todo]
    return start


def transfer(block: Block, state: set[str], sources: tuple[str, ...], sanitizers: tuple[str, ...]) -> set[str]:
    for r in block:
        if r["kind"] == "assign":
            callee = r.get("callee") or ""
            clean = any(s in callee for s in sanitizers)
            dirty = not clean and (any(callee.startswith(s) for s in sources if callee) or any(a in state or _root(a) in state for a in r["args"]))
            (state.add if dirty else state.discard)(r["lhs"])
    return state


def analyse_function(rows: list[dict], params: list[str], rules: list[dict], sources: tuple[str, ...], sanitizers: tuple[str, ...], limit: int = MAX_BLOCKS) -> list[tuple[str, int, str, str]]:
    """(rule, line, callee, status) for each sink reached by taint, or ("", 0, "", "skipped") for a function beyond the limit."""
    try:
        blocks, succ = build_blocks(rows, limit)
    except OverflowError:
        return [("", 0, "", "skipped")]
    seeds = {p for p in params if any(p.startswith(s) for s in sources)}
    state = tainted_in(blocks, succ, seeds, sources, sanitizers)
    guarded = [{a for r in b if r["kind"] == "call" and any(s in (r.get("callee") or "") for s in sanitizers) for a in r["args"]} for b in blocks]
    dom = dominators(succ) if any(guarded) else [set() for _ in blocks]  # needed only where something is checked
    found = []
    for k, block in enumerate(blocks):
        now, passed = set(state[k]), set().union(*(guarded[d] for d in dom[k] if d != k))
        for r in block:
            callee = r.get("callee") or ""
            if r["kind"] == "call":
                for rule in rules:
                    if (callee == rule["pattern"]) if rule["match"] == "exact" else (rule["pattern"] in callee):
                        args = r["args"] if rule["arg"] is None else r["args"][rule["arg"] : rule["arg"] + 1]
                        bad = [a for a in args if (a in now or _root(a) in now) and a not in passed]
                        if bad and not any(s in a for s in rule["sanitizers"] for a in r["args"]):
                            found.append((rule["rule"], int(r["line"]), callee, "finding"))
                passed |= set(r["args"]) if any(s in callee for s in sanitizers) else set()
            now = transfer([r], now, sources, sanitizers)
    return found


def _means(rule: dict) -> Column:
    return F.col("callee") == rule["pattern"] if rule["match"] == "exact" else F.contains("callee", F.lit(rule["pattern"]))


def cfg_findings(il: DataFrame, rules: list[dict], sources: tuple[str, ...], sanitizers: tuple[str, ...], params: DataFrame | None = None, limit: int = MAX_BLOCKS) -> DataFrame:
    """(file, fn, rule, line, callee, status) from il(file, fn, ord, kind, lhs, callee, args, line) and params(file, fn, params).

    A function with a sink and over ``limit`` blocks gives one row with the status "skipped".
    """
    sink = reduce(lambda a, b: a | b, [_means(r) for r in rules], F.lit(False))
    wanted = il.where("kind = 'call'").where(sink).select("file", "fn").distinct()
    first = params.select("file", "fn", "params") if params is not None else None
    rows = il.join(large(wanted), ["file", "fn"], "left_semi").select("file", "fn", "ord", "kind", "lhs", "callee", "args", "line")
    rows = rows.join(large(first), ["file", "fn"], "left") if first is not None else rows.withColumn("params", F.array().cast("array<string>"))

    def found(key: tuple, recs: list[dict], p: list | None) -> Iterator[tuple]:
        for f in dict.fromkeys(analyse_function(recs, list(p or []), rules, sources, sanitizers, limit)):
            yield (*key, *f)

    def run(batches):
        key, recs, p = None, [], None
        for b in batches:
            out = []
            for r in b.to_pylist():
                at = (r["file"], r["fn"])
                if at != key:
                    out += found(key, recs, p) if recs else ()
                    key, recs, p = at, [], r["params"]
                recs.append({"kind": r["kind"], "lhs": r["lhs"], "callee": r["callee"], "args": r["args"] or [], "line": r["line"]})
            yield batch(out)
        yield batch(found(key, recs, p) if recs else ())

    def batch(rows_):
        columns = list(zip(*rows_, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "fn", "rule", "line", "callee", "status"])

    laid = rows.repartition("file", "fn").sortWithinPartitions("file", "fn", "ord")
    return laid.mapInArrow(run, "file string, fn string, rule string, line int, callee string, status string")
