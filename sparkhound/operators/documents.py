"""Analyses of whole documents, for the tasks that parse them (trees.by_document): statements, flow, kinds of values, lint, forms.

Each gives for one document's expression rows what the operator named beside it gives for rows in tables, where they
have to be sorted and joined. A tree's rows are numbered from 0 in pre-order, so a row's number is its place in the list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from hashlib import md5

from . import cfg
from .lowering import _CHOOSES, _TAKES
from .types import _BRANCHES

#: Places in a row: schema.EXPRS without the file.
FN, ID, PARENT, IX, KIND, NAME, LITERAL_KIND, LITERAL, OP, LINE, DEPTH, _, END = range(13)
_CONTAINERS = frozenset(("class", "module", "enum"))
_BEGINS = frozenset(("function", "lambda"))
_PLAIN = frozenset(("var", "field", "param"))
_VALUES = frozenset(("app", "binary", "unary", "tuple", "list", "record", "block"))
_TAKERS, _CHOOSERS, _FORKS = frozenset(_TAKES), frozenset(_CHOOSES), frozenset(_BRANCHES)
_IFS = frozenset(("if", "ternary", "while"))
_BINDS = frozenset(("let", "assign", "param"))
_SAFE, _BLANK = frozenset(("binary", "unary", "list", "tuple", "record", "lambda")), frozenset(("field", "param", "while", "try"))


def trees(rows: list[tuple]) -> list[list[tuple]]:
    """A document's rows tree by tree."""
    out: dict[str, list[tuple]] = {}
    for r in rows:
        out.setdefault(r[FN], []).append(r)
    return list(out.values())


def _places(tree: list[tuple]) -> list[int]:
    """The greatest place among each row's children, -2 where there are none."""
    top = [-2] * len(tree)
    for r in tree:
        up = r[PARENT]
        if up is not None and r[IX] > top[up]:
            top[up] = r[IX]
    return top


def _owners(tree: list[tuple]) -> list[str | None]:
    """lowering._owned: the function each row is a statement of."""
    fn_id, own, inner, around = tree[0][FN], [], [], []
    for r in tree:
        up, kind = r[PARENT], r[KIND]
        outer, level = (None, 0) if up is None else (inner[up], around[up])
        here = outer
        if kind in _BEGINS:
            within = fn_id if r[ID] == 0 and kind == "function" else f"{fn_id}/{r[ID]}"
        elif fn_id == "" and kind not in _CONTAINERS and r[DEPTH] == level:
            here = within = f"/{r[ID]}"
        else:
            within = outer
        own.append(here)
        inner.append(within)
        around.append(level + (kind in _CONTAINERS))
    return own


def _operand(r: tuple) -> str:
    kind = r[KIND]
    if kind in _PLAIN and r[ID] == r[END] and r[NAME]:
        return r[NAME]
    return f'"{r[LITERAL] or ""}"' if kind == "literal" else f"%{r[ID]}"


def statements(tree: list[tuple], own: list[str | None] | None = None) -> dict[str, list[tuple]]:
    """lowering.lower: (kind, lhs, callee, args, line) in order, by function."""
    own, top = _owners(tree) if own is None else own, _places(tree)
    kids: list[list[tuple] | None] = [None] * len(tree)
    used: list[bool] = []
    operands = [_operand(r) for r in tree]
    for r in tree:
        up = r[PARENT]
        if up is None:
            used.append(False)
            continue
        if kids[up] is None:
            kids[up] = [r]
        else:
            kids[up].append(r)
        kind, ix = tree[up][KIND], r[IX]
        used.append(used[up] if kind == "block" and ix == top[up] or kind in _CHOOSERS and ix > 0 else kind in _TAKERS)
    out: dict[str, list[tuple]] = {}
    todo: list[tuple] = []

    def leave(r: tuple) -> None:
        at, kind, line, up, fn = r[ID], r[KIND], r[LINE], r[PARENT], own[r[ID]]
        if fn is None:
            return
        mine = kids[at] or ()
        if len(mine) > 1 and any(a[IX] > b[IX] for a, b in zip(mine, mine[1:], strict=False)):
            mine = sorted(mine, key=lambda k: (k[IX], k[ID]))  # what a name is reached through comes first
        n, add = len(mine), out.setdefault(fn, []).append
        if kind == "app":
            add(("call", None, r[NAME], [operands[k[ID]] for k in mine if k[IX] >= 0], line))
        if used[at] and (kind in _VALUES or kind == "field" and n):
            callee = r[NAME] if kind == "app" else r[OP] if kind in ("binary", "unary") else None
            add(("assign", f"%{at}", callee, [operands[k[ID]] for k in (mine[-1:] if kind == "block" else mine)], line))
        if kind in ("let", "assign"):
            if r[NAME]:
                add(("assign", r[NAME], None, [operands[k[ID]] for k in mine], line))
        elif kind in ("return", "raise", "error"):
            add(("return", None, None, [operands[k[ID]] for k in mine], line))
        elif kind == "try":
            add(("call", None, "try", ["%try"], line))
        elif kind in _IFS:
            if n:
                add(("end", None, None, [], line))
        elif kind == "case":
            for _ in range(n - 2):
                add(("end", None, None, [], line))
        if up is not None:
            above, ix = tree[up], r[IX]
            of_if = above[KIND] in _IFS
            if of_if or above[KIND] == "case":
                if ix > 0 and used[at]:
                    add(("assign", f"%{up}", None, [operands[at]], line))
                if of_if:
                    if ix == 0:
                        add(("branch", None, None, [operands[at]], above[LINE]))
                elif 1 <= ix < top[up]:
                    add(("else", None, None, [], above[LINE]))

    for r in tree:
        at, up = r[ID], r[PARENT]
        while todo and todo[-1][END] < at:
            leave(todo.pop())
        if up is not None and own[at] is not None:
            above = tree[up]
            if above[KIND] in _IFS:
                if r[IX] == 2:
                    out.setdefault(own[at], []).append(("else", None, None, [], above[LINE]))
            elif above[KIND] == "case" and 1 <= r[IX] < top[up]:
                out.setdefault(own[at], []).append(("branch", None, None, [], above[LINE]))
        if r[END] == at:
            leave(r)
        else:
            todo.append(r)
    while todo:
        leave(todo.pop())
    return out


def flow_findings(rows: list[tuple], rules: list[dict], sources: tuple[str, ...], sanitizers: tuple[str, ...], limit: int = cfg.MAX_BLOCKS) -> list[tuple]:
    """cfg.cfg_findings of lowering.lower and lowering.parameters: (fn, rule, line, callee, status)."""
    out = []
    meant = lambda callee: any(callee == r["pattern"] if r["match"] == "exact" else r["pattern"] in callee for r in rules)
    for tree in trees(rows):
        own = _owners(tree)
        params: dict[str | None, list[str]] = {}
        for r in tree:
            if r[KIND] == "param" and r[NAME]:
                params.setdefault(own[r[ID]], []).append(r[NAME])
        for fn, il in statements(tree, own).items():
            if any(s[0] == "call" and meant(s[2]) for s in il):
                recs = [{"kind": k, "lhs": lhs, "callee": callee, "args": args, "line": line} for k, lhs, callee, args, line in il]
                out += [(fn, *f) for f in dict.fromkeys(cfg.analyse_function(recs, params.get(fn, []), rules, sources, sanitizers, limit))]
    return out


_BITS = {"safe": 1, "nullable": 2, "result": 4, "unknown": 8}
_JOINED = [None, "safe", "nullable", "nullable", "result", *["unknown"] * 11]


def value_kinds(tree: list[tuple], returns: dict[str, str]) -> list[str | None]:
    """types.kinds of one tree: each row's kind, None where it has none. ``returns``: what calls return, in the tree's language."""
    top = _places(tree)
    known, flow = [0] * len(tree), [[] for _ in tree]
    bound: dict[str, int] = {}
    for r in tree:
        at, kind, up, name = r[ID], r[KIND], r[PARENT], r[NAME]
        if up is not None:
            above = tree[up][KIND]
            if above in ("let", "assign", "block") and r[IX] == top[up] or above in _FORKS and r[IX] > 0:
                flow[at].append(up)
        if kind == "app":
            known[at] = _BITS[returns.get(name) or returns.get(name.rsplit(".", 1)[-1]) or "unknown"]
        elif kind == "var":
            if name in bound:
                flow[bound[name]].append(at)
            else:
                known[at] = 8
        elif kind == "literal":
            known[at] = 2 if r[LITERAL_KIND] == "null" else 1
        elif kind in _SAFE:
            known[at] = 1
        elif kind in _BLANK:
            known[at] = 8
        elif kind == "if" and top[at] == 1:
            known[at] = 2  # without else it may yield nothing
        if kind in _BINDS and name:
            bound[name] = at
    todo = [at for at, k in enumerate(known) if k]
    while todo:
        at = todo.pop()
        k = known[at]
        for to in flow[at]:
            if known[to] | k != known[to]:
                known[to] |= k
                todo.append(to)
    return [_JOINED[k] for k in known]


def ignored_results(tree: list[tuple], known: list[str | None]) -> list[tuple[str, str]]:
    """types.ignored_results: (rule, subject), as all that follow."""
    top = _places(tree)
    return [("ignored-result", r[NAME]) for r in tree if r[KIND] == "app" and r[PARENT] is not None and known[r[ID]] == "result" and tree[r[PARENT]][KIND] == "block" and r[IX] != top[r[PARENT]]]


def unchecked_nullables(tree: list[tuple], known: list[str | None]) -> list[tuple[str, str]]:
    """types.unchecked_nullables."""
    bound: dict[str, int] = {}
    through = {r[PARENT] for r in tree if r[IX] == -1 and known[r[ID]] == "nullable"}
    out = []
    for r in tree:
        kind, name = r[KIND], r[NAME]
        if kind in ("app", "field"):
            at = bound.get(name.split(".", 1)[0]) if "." in name else None
            if r[ID] in through or at is not None and known[at] == "nullable":
                out.append(("unchecked-nullable", name))
        elif kind in _BINDS and name:
            bound[name] = r[ID]
    return out


def name_lookup(tree: list[tuple], names: dict[str, str]) -> list[tuple[str, str]]:
    """exprs.name_lookup; ``names``: the rule of a name."""
    return [(names[r[NAME]], r[NAME]) for r in tree if r[KIND] in ("app", "field") and r[NAME] in names]


def shape(tree: list[tuple], parent: Callable[[tuple], bool], child: Callable[[tuple], bool], rule: str) -> list[tuple[str, str]]:
    """exprs.shape."""
    hit = {r[PARENT] for r in tree if child(r)}
    return [(rule, r[NAME]) for r in tree if r[ID] in hit and parent(r)]


def count_over(tree: list[tuple], which: Callable[[tuple], bool], least: int, rule: str) -> list[tuple[str, str]]:
    """exprs.count_over."""
    n = sum(map(which, tree))
    return [(rule, str(n))] if n >= least else []


def literal_match(tree: list[tuple], test: Callable[[str], bool], rule: str) -> list[tuple[str, str]]:
    """exprs.literal_match."""
    return [(rule, r[LITERAL]) for r in tree if r[KIND] == "literal" and test(r[LITERAL])]


def followed_by(tree: list[tuple], first: str, then: str, rule: str) -> list[tuple[str, str]]:
    """exprs.followed_by, of names, not adjacent."""
    seen, out = False, []
    for r in tree:
        if r[KIND] in ("app", "return", "raise", "assign"):
            if seen and r[NAME] == then:
                out.append((rule, r[NAME]))
            seen = seen or r[NAME] == first
    return out


def nested_deeper(tree: list[tuple], kind: str, least: int, rule: str) -> list[tuple[str, str]]:
    """exprs.nested_deeper."""
    level, out = [], []
    for r in tree:
        n = (0 if r[PARENT] is None else level[r[PARENT]]) + (r[KIND] == kind)
        level.append(n)
        if r[KIND] == kind and n >= least:
            out.append((rule, str(n)))
    return out


def unused_bindings(tree: list[tuple], rule: str = "unused-binding") -> list[tuple[str, str]]:
    """exprs.unused_bindings."""
    last = {r[NAME].split(".", 1)[0]: r[ID] for r in tree if r[KIND] in ("var", "app", "field")}
    return [(rule, r[NAME]) for r in tree if r[KIND] in ("let", "param") and not r[NAME].startswith("_") and last.get(r[NAME], -1) <= r[ID]]


def shadowed(tree: list[tuple], rule: str = "shadow-variable") -> list[tuple[str, str]]:
    """exprs.shadowed."""
    n = Counter(r[NAME] for r in tree if r[KIND] in ("let", "param") and r[NAME] != "_")
    return [(rule, name) for name, k in n.items() for _ in range(k - 1)]


def forms(tree: list[tuple], length: int = 40, depth: int = 4) -> set[bytes]:
    """exprs.duplicate_trees: hashes of the forms of subtrees that are long enough."""
    parts: list[list[str]] = [[] for _ in tree]
    for r in tree:
        kind, at = r[KIND], r[ID]
        text = f"{kind}:{'_' if kind in ('var', 'param', 'let', 'assign') else r[NAME]}:{r[OP] or ''}:{r[LITERAL] or ''}"
        for level in range(depth + 1):
            parts[at].append(f"{level}/{text}")
            at = tree[at][PARENT]
            if at is None:
                break
    out = set()
    for r in tree:
        if r[END] > r[ID]:
            form = " ".join(parts[r[ID]])
            if len(form) >= length:
                out.add(md5(form.encode(), usedforsecurity=False).digest())
    return out
