"""Which assertions of a function can no longer fail its test.

An assertion fails a test by an exception, so it can't where something around it takes that exception
and goes on: a handler from whose end, or from a return in it, the test continues; a context that
suppresses it; a `finally` that leaves by a return. Whether a handler goes on is read off all paths
through its statements.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

# The two kinds of exception that fail a test, with the names that catch them.
CATCHING = {"assertion": {"AssertionError", "Exception", "BaseException"}, "outcome": {"BaseException"}}
FAILING = frozenset(CATCHING)

#: How a statement may end: with the next one, by an exception, out of the function, out of or to the head of a loop.
NEXT, RAISE, RETURN, LOOP = "next", "raise", "return", "loop"
_PLAIN = {ast.Raise: RAISE, ast.Return: RETURN, ast.Break: LOOP, ast.Continue: LOOP}
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_CONTEXTS = (ast.With, ast.AsyncWith)
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_TRIES = (ast.Try, ast.TryStar)


def _name(node: ast.AST) -> str:
    """The last name of a dotted one; empty for anything else."""
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _names(node: ast.AST) -> set[str]:
    return {_name(x) for x in (node.elts if isinstance(node, ast.Tuple) else [node])}


def _suppressed(statement: ast.AST) -> frozenset[str]:
    """What kinds the contexts of a `with` suppress."""
    calls = [i.context_expr for i in getattr(statement, "items", ()) if isinstance(i.context_expr, ast.Call) and _name(i.context_expr.func) == "suppress"]
    named = {_name(a) for c in calls for a in c.args}
    return frozenset(kind for kind, names in CATCHING.items() if names & named)


def _constant(node: ast.AST, value: bool) -> bool:
    return isinstance(node, ast.Constant) and bool(node.value) is value


def ends(statements: list[ast.stmt]) -> set[str]:
    """All ways in which a list of statements may end."""
    out = {NEXT}
    for s in statements:
        if NEXT not in out:
            break
        out = (out - {NEXT}) | _ends(s)
    return out


def _ends(s: ast.stmt) -> set[str]:
    if type(s) in _PLAIN:
        return {_PLAIN[type(s)]}
    if isinstance(s, ast.Assert):
        return {RAISE} if _constant(s.test, False) else {NEXT, RAISE}
    if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and _name(s.value.func) in ("fail", "skip", "skipTest"):
        # A failure is an exception again; a skipped test doesn't fail.
        return {RAISE} if _name(s.value.func) == "fail" else {RETURN}
    if isinstance(s, ast.If):
        return ends(s.body) | ends(s.orelse)
    if isinstance(s, _LOOPS):
        inner = ends(s.body)
        endless = isinstance(s, ast.While) and _constant(s.test, True) and LOOP not in inner
        return (inner - {NEXT, LOOP}) | (set() if endless else ends(s.orelse) | ({NEXT} if LOOP in inner else set()))
    if isinstance(s, _CONTEXTS):
        inner = ends(s.body)
        return inner | {NEXT} if RAISE in inner and _suppressed(s) else inner
    if isinstance(s, ast.Match):
        return {NEXT}.union(*(ends(c.body) for c in s.cases))
    if isinstance(s, _TRIES):
        body = ends(s.body)
        out = (body - {NEXT}) | (ends(s.orelse) if NEXT in body else set())
        # Anything in the body may raise, so every handler may be entered.
        out = out.union(*(ends(h.body) for h in s.handlers))
        last = ends(s.finalbody)
        return last if NEXT not in last else out | (last - {NEXT})
    return {NEXT}


def _taken(s: ast.Try, kind: str) -> bool:
    """Whether an exception of the kind ends in a handler that goes on: the first that catches it counts."""
    first = next((h for h in s.handlers if h.type is None or CATCHING[kind] & _names(h.type)), None)
    return first is not None and ends(first.body) != {RAISE}


def _blocks(s: ast.stmt, around: frozenset[str]) -> Iterator[tuple[list[ast.stmt], frozenset[str]]]:
    """The blocks of a compound statement, each with the kinds that something around it takes."""
    if isinstance(s, _TRIES):
        leaving = FAILING if ends(s.finalbody) & {RETURN, LOOP} else frozenset()
        yield s.body, around | leaving | {k for k in FAILING if _taken(s, k)}
        for block in (*(h.body for h in s.handlers), s.orelse):
            yield block, around | leaving
        yield s.finalbody, around
    elif isinstance(s, _CONTEXTS):
        yield s.body, around | _suppressed(s)
    elif isinstance(s, ast.Match):
        yield from ((c.body, around) for c in s.cases)
    else:
        yield from ((block, around) for block in (getattr(s, "body", []), getattr(s, "orelse", [])))


def taken(statements: list[ast.stmt]) -> dict[int, frozenset[str]]:
    """By id() of a node, the kinds of exception that something around it takes: of asserts and calls for which that is any. Nested functions and classes aren't entered."""
    out: dict[int, frozenset[str]] = {}
    todo = [(s, frozenset()) for s in statements]
    while todo:
        s, around = todo.pop()
        if isinstance(s, _SCOPES):
            continue
        inside = [(block, kinds) for block, kinds in _blocks(s, around) if isinstance(block, list)]
        if around:
            below = {id(x) for block, _ in inside for x in block}
            own = [s, *(n for child in ast.iter_child_nodes(s) if id(child) not in below and not isinstance(child, ast.ExceptHandler | ast.match_case) for n in ast.walk(child))]
            out.update((id(n), around) for n in own if isinstance(n, ast.Assert | ast.Call))
        todo += [(x, kinds) for block, kinds in inside for x in block]
    return out
