"""The test surface of one Python source, from the standard library's syntax tree.

Only what a runner may collect counts: functions and classes at the top of the module. Operands are
kept as they are written, parentheses included, with white space collapsed, so the source text is
consulted where the tree drops it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from typing import NamedTuple

from tessera.operators.control_flow import taken

# Assertion methods by kind, with whether they negate.
METHODS = {
    "assertEqual": ("equality", False),
    "assertNotEqual": ("equality", True),
    "assertIs": ("identity", False),
    "assertIsNot": ("identity", True),
    "assertTrue": ("truthiness", False),
    "assertFalse": ("truthiness", True),
    "assertIsNone": ("existence", True),
    "assertIsNotNone": ("existence", False),
    "assertIn": ("membership", False),
    "assertNotIn": ("membership", True),
    "assertGreater": ("comparison", False),
    "assertGreaterEqual": ("comparison", False),
    "assertLess": ("comparison", False),
    "assertLessEqual": ("comparison", False),
    "assertAlmostEqual": ("approximate", False),
    "assertNotAlmostEqual": ("approximate", True),
    "assertIsInstance": ("type", False),
    "assertNotIsInstance": ("type", True),
    "assertRaises": ("exception", False),
    "assertRaisesRegex": ("exception", False),
    "assertRaisesRegexp": ("exception", False),
    "assertWarns": ("exception", False),
    "assertCountEqual": ("equality", False),
    "assertListEqual": ("equality", False),
    "assertDictEqual": ("equality", False),
    "assertSetEqual": ("equality", False),
    "assertTupleEqual": ("equality", False),
    "assertMultiLineEqual": ("equality", False),
    "assertRegex": ("custom", False),
    "assertNotRegex": ("custom", True),
}
MOCK_METHODS = ("assert_any_call", "assert_has_calls", "assert_not_called")
COMPARISONS = {
    ast.Is: ("identity", False), ast.IsNot: ("identity", True), ast.In: ("membership", False), ast.NotIn: ("membership", True),
    ast.Eq: ("equality", False), ast.NotEq: ("equality", True),
}

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef)
_STRING = re.compile(r"[A-Za-z]*('''|\"\"\"|'|\")(.*)\1", re.DOTALL)


class Source:
    """A syntax tree with its text."""

    def __init__(self, text: str):
        self.tree = ast.parse(text)
        self.bytes = text.encode()
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.bytes))]

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def written(self, node: ast.AST, low: int | None = None, high: int | None = None) -> str:
        """The node's text with the parentheses around it that lie within [low, high)."""
        a, b = self.span(node)
        if low is not None:
            while (m := re.search(rb"\(\s*$", self.bytes[low:a])) and (n := re.match(rb"\s*,?\s*\)", self.bytes[b:high])):
                a, b = low + m.start(), b + n.end()
        return self.bytes[a:b].decode("utf-8", "replace")

    def operand(self, node: ast.AST, low: int | None = None, high: int | None = None) -> str:
        return " ".join(self.written(node, low, high).split())

    def last_name(self, node: ast.AST) -> str:
        return node.attr if isinstance(node, ast.Attribute) else self.written(node)

    def arguments(self, call: ast.Call) -> tuple[list[tuple[ast.AST, str]], dict[str, str]]:
        """Positional arguments (starred ones too) with their texts, and keyword arguments' texts as written."""
        _, after = self.span(call.func)
        end = self.span(call)[1]
        low = after + self.bytes[after:end].index(b"(") + 1
        while self.bytes[after:low].count(b")"):  # parentheses around the callee end first
            after = after + self.bytes[after:low].index(b")") + 1
            low = after + self.bytes[after:end].index(b"(") + 1
        own = sorted([*call.args, *(k for k in call.keywords if k.arg is None)], key=self.span)
        named: dict[str, str] = {}
        for k in call.keywords:
            if k.arg is not None:
                named.setdefault(k.arg, self.written(k.value, self.span(k)[0] + len(k.arg.encode()), end - 1))
        return [(a, self.operand(a, low, end - 1)) for a in own], named

    def string(self, node: ast.AST) -> str | None:
        """The undecoded content of a plain string: one literal, nothing interpolated."""
        plain = isinstance(node, ast.Constant) and isinstance(node.value, str | bytes) or isinstance(node, ast.JoinedStr) and not any(isinstance(v, ast.FormattedValue) for v in node.values)
        m = _STRING.fullmatch(self.written(node)) if plain else None
        if m is None or len(m[1]) == 1 and re.search(rf"(?<!\\)(?:\\\\)*{m[1]}", m[2]):
            return None
        return m[2]


def _number(text: str | None, kind: type):
    try:
        return None if text is None else kind(text)
    except ValueError:
        return None


#: Nodes with no placed node below them.
_LEAVES = (ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.alias)


def _inside(node: ast.AST) -> list[ast.AST]:
    """Child nodes in source order; those without a place give way to their children."""
    out: list[ast.AST] = []
    for child in ast.iter_child_nodes(node):
        out += [child] if hasattr(child, "lineno") else _inside(child)
    return sorted(out, key=lambda n: (n.lineno, n.col_offset)) if len(out) > 1 else out


def _below(node: ast.AST):
    """Nodes below a node, each before those below it, without the insides of nested scopes; their decorators count."""
    for child in _inside(node):
        if isinstance(child, _SCOPES):
            for d in child.decorator_list:
                yield d
                yield from _below(d)
            continue
        yield child
        if not isinstance(child, _LEAVES):
            yield from _below(child)


class Reader:
    """Tests of one source and what tells its framework."""

    def __init__(self, path: str, source: Source):
        self.path, self.source = path, source
        self.pytest = self.unittest = False
        #: Kinds of failure that something around a node of the current test takes.
        self.taken: dict[int, frozenset[str]] = {}

    def tests(self) -> list[dict]:
        out = []
        for node in self.source.tree.body:
            if isinstance(node, ast.Import) or isinstance(node, ast.ImportFrom) and node.module != "__future__":
                self.pytest |= "pytest" in self.source.written(node)
            elif isinstance(node, _FUNCTIONS):
                out.append(self.test(node, None))
            elif isinstance(node, ast.ClassDef):
                case = any(self.source.last_name(b) == "TestCase" for b in node.bases)
                self.unittest |= case
                if case or node.name.startswith("Test"):
                    out += [self.test(x, node.name) for x in node.body if isinstance(x, _FUNCTIONS)]
        return [t for t in out if t is not None]

    def test(self, node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> dict | None:
        if not node.name.lstrip("_").startswith("test"):
            return None
        found: dict[str, list[dict]] = {"assertions": [], "skip_markers": [], "mocks": [], "retries": []}
        for d in node.decorator_list:
            self.decorator(d, found)
        used = set()
        self.taken = taken(node.body)
        for statement in node.body:
            if isinstance(statement, _SCOPES):
                walked = [x for d in statement.decorator_list for x in (d, *_below(d))]
            else:
                walked = [statement, *_below(statement)]
            for x in walked:
                if isinstance(x, ast.Assert):
                    self.pytest = True
                    found["assertions"].append(self.stated(x))
                elif isinstance(x, ast.Call) and not self.call(x, found):
                    name = self.source.last_name(x.func)
                    if name and not (len(name) > 4 and name.startswith("__") and name.endswith("__")):
                        used.add(name)
        names = [n for n in (owner, node.name) if n]
        first = node.decorator_list[0].lineno if node.decorator_list else node.lineno
        return {
            "id": "::".join([self.path, *names]), "name": node.name, "qualname": ".".join(names), "line_start": first, "line_end": node.end_lineno,
            "is_discoverable": node.name.startswith("test_"), **found, "exercised_symbols": sorted(used),
        }

    def stated(self, node: ast.Assert) -> dict:
        """The record of an assert statement: `not`s in front are peeled off, then the type of what is left tells how to read it."""
        s = self.source
        low, high = s.span(node)[0] + len("assert"), s.span(node.msg or node)[0 if node.msg else 1]
        test, negated = node.test, False

        def bracketed() -> bool:  # in parentheses: a truth value of its own
            return b"(" in s.bytes[low : s.span(test)[0]]

        while not bracketed() and isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            (at, high), negated = s.span(test), not negated
            low, test = at + len("not"), test.operand
        claim = None if bracketed() else _READINGS.get(type(test), lambda *_: None)(s, test)
        claim = claim or Claim("truthiness", [s.operand(test, low, high)], [_is_literal(s, test)])
        return _assertion(claim.kind, "assert", node.lineno, claim.operands, claim.literal, claim.tolerance, negated != claim.negated, "assertion" in self.taken.get(id(node), ()))

    def call(self, node: ast.Call, found: dict[str, list[dict]]) -> bool:
        """Whether the call has a known shape; if so its record is noted."""
        return self.noted(CALLS, Seen.of(self.source, node), found)

    def decorator(self, node: ast.AST, found: dict[str, list[dict]]) -> None:
        self.noted(DECORATORS, Seen.of(self.source, node), found)

    def noted(self, shapes: tuple[Shape, ...], seen: Seen, found: dict[str, list[dict]]) -> bool:
        shape = next((x for x in shapes if x.fits(seen)), None)
        if shape is None:
            return False
        record = shape.record(seen)
        if shape.into == "assertions":
            record["swallowed"] = ("outcome" if "pytest" in seen.callee else "assertion") in self.taken.get(id(seen.node), ())
        found[shape.into].append(record)
        self.pytest |= shape.shows == "pytest"
        self.unittest |= shape.shows == "unittest"
        return True


class Claim(NamedTuple):
    """What an asserted expression claims."""

    kind: str
    operands: list[str]
    literal: list[bool]
    negated: bool = False
    tolerance: float | None = None


def _is_none(s: Source, node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and node.value is None


def _is_approx(s: Source, node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and s.last_name(node.func) == "approx"


_LITERAL_PARTS = (ast.Constant, ast.Tuple, ast.List, ast.Set, ast.Dict, ast.UnaryOp, ast.UAdd, ast.USub, ast.Load)


def _is_literal(s: Source, node: ast.AST) -> bool:
    """Whether an operand is written out as a value: constants, signs and displays of them, or an approximation to such."""
    if _is_approx(s, node) and node.args:
        return all(_is_literal(s, a) for a in node.args)
    return all(isinstance(n, _LITERAL_PARTS) for n in ast.walk(node))


#: A kind of comparison that becomes another when a side, written without parentheses, has a trait; whether that turns the sense.
_REFINED = {"identity": (_is_none, "existence", True), "equality": (_is_approx, "approximate", False)}


def _compared(s: Source, node: ast.Compare) -> Claim:
    span, sides = s.span(node), (node.left, *node.comparators)
    written = [s.operand(x, *span) for x in sides]
    base, opposite = COMPARISONS.get(type(node.ops[0]), ("comparison", False))
    claim = Claim(base, written, [_is_literal(s, x) for x in sides], opposite)
    if claim.kind in _REFINED:
        trait, kind, turns = _REFINED[claim.kind]
        for side, text in zip(sides, written, strict=True):
            if text == s.operand(side) and trait(s, side):
                given = s.arguments(side)[1] if isinstance(side, ast.Call) else {}
                return claim._replace(kind=kind, negated=claim.negated != turns, tolerance=_number(given.get("abs", given.get("rel")), float))
    return claim


def _checked_type(s: Source, node: ast.Call) -> Claim | None:
    if s.last_name(node.func) != "isinstance":
        return None
    own = s.arguments(node)[0]
    return Claim("type", [t for _, t in own], [_is_literal(s, n) for n, _ in own])


_READINGS = {ast.Compare: _compared, ast.Call: _checked_type}


class Seen(NamedTuple):
    """A call or decorator as shapes see it."""

    source: Source
    node: ast.AST
    name: str
    callee: str
    line: int
    nodes: list[ast.AST]
    texts: list[str]
    named: dict[str, str]

    @classmethod
    def of(cls, source: Source, node: ast.AST) -> Seen:
        head = node.func if isinstance(node, ast.Call) else node
        own, named = source.arguments(node) if isinstance(node, ast.Call) else ([], {})
        return cls(source, node, source.last_name(head), source.operand(head), node.lineno, [n for n, _ in own], [t for _, t in own], named)

    @property
    def first(self) -> str | None:
        return next(iter(self.texts), None)

    @property
    def literal(self) -> list[bool]:
        return [_is_literal(self.source, n) for n in self.nodes]


class Shape(NamedTuple):
    """Calls of some names, `within` in the callee and `without` not, give a record in a list of the test and may show its framework."""

    into: str
    names: Callable[[str], bool]
    record: Callable[[Seen], dict]
    within: str = ""
    without: str | None = None
    shows: str = ""

    def fits(self, seen: Seen) -> bool:
        return self.names(seen.name) and self.within in seen.callee and (self.without is None or self.without not in seen.callee)


def _named(*names: str) -> Callable[[str], bool]:
    return frozenset(names).__contains__


def _known_method(name: str) -> tuple[str, bool] | None:
    """Kind and sense of an assertion method: by the table, by mocks' names, else any name that begins like one."""
    families = ((name in MOCK_METHODS or name.startswith("assert_called"), "call"), (name == "fail" or name.startswith("assert"), "custom"))
    return METHODS.get(name) or next(((kind, False) for own, kind in families if own), None)


def _method_record(seen: Seen) -> dict:
    kind, negated = _known_method(seen.name)
    return _assertion(kind, seen.name, seen.line, seen.texts, seen.literal, _number(seen.named.get("delta"), float) if kind == "approximate" else None, negated)


def _skipping(reason: str, *, shown: bool = False) -> Callable[[Seen], dict]:
    return lambda seen: {"reason": reason, "line": seen.line, "expression": seen.first if shown else None}


def _retrying(*fields: str) -> Callable[[Seen], dict]:
    """Attempts from the first of these that is given: a keyword, or `0` for the first argument."""

    def record(seen: Seen) -> dict:
        numbers = (_number(seen.first if f == "0" else seen.named.get(f), int) for f in fields)
        given = next((n for n in numbers if n is not None), None)
        # A count that no column of the schema can hold is as good as none.
        return {"callee": seen.name, "line": seen.line, "max_attempts": given if given is not None and abs(given) < 1 << 31 else None}

    return record


def _mocking(*, attribute_as_written: bool = False) -> Callable[[Seen], dict]:
    """What is replaced: a string, or an object and the name of its attribute."""

    def record(seen: Seen) -> dict:
        strings = [seen.source.string(n) for n in seen.nodes[:2]]
        parts = seen.texts[:1]
        if strings and strings[0] is not None:
            parts = [strings[0]]
        elif len(strings) > 1:
            parts += [x for x in (strings[1], seen.texts[1] if attribute_as_written else None) if x is not None][:1]
        return {"target": ".".join(parts), "line": seen.line, "callee": seen.callee}

    return record


_PATCHES = (Shape("mocks", _named("patch"), _mocking(), without="mark"), Shape("mocks", _named("object", "dict"), _mocking(), "patch", without="mark"))
#: The first shape that fits counts. A decorator of marks is never read as anything else.
DECORATORS = (
    Shape("skip_markers", _named("skip"), _skipping("skip"), "mark", shows="pytest"),
    Shape("skip_markers", _named("skipif"), _skipping("skip_if", shown=True), "mark", shows="pytest"),
    Shape("skip_markers", _named("xfail"), _skipping("expected_failure"), "mark", shows="pytest"),
    Shape("retries", _named("flaky"), _retrying("reruns"), "mark", shows="pytest"),
    Shape("retries", _named("repeat"), _retrying("0"), "mark", shows="pytest"),
    Shape("skip_markers", _named("expectedFailure"), _skipping("expected_failure"), without="mark"),
    Shape("skip_markers", _named("skip"), _skipping("skip"), "unittest", "mark"),
    Shape("skip_markers", _named("skipIf"), _skipping("skip_if", shown=True), "unittest", "mark"),
    Shape("retries", _named("flaky"), _retrying("max_runs", "0"), without="mark"),
    *_PATCHES,
)
CALLS = (
    Shape("assertions", _named("raises"), lambda seen: _assertion("exception", "raises", seen.line, seen.texts, seen.literal), "pytest", shows="pytest"),
    Shape("assertions", lambda name: _known_method(name) is not None, _method_record, shows="unittest"),
    Shape("skip_markers", _named("skip"), _skipping("skip"), "pytest", shows="pytest"),
    *(x._replace(without=None) for x in _PATCHES),
    Shape("mocks", _named("setattr"), _mocking(attribute_as_written=True), "monkeypatch"),
)


def _assertion(kind: str, callee: str, line: int, operands: list[str], literal: list[bool], tolerance: float | None = None, negated: bool = False, swallowed: bool = False) -> dict:
    return {"kind": kind, "callee": callee, "line": line, "operands": operands, "tolerance": tolerance, "negated": negated, "literal": literal, "swallowed": swallowed}


def extract(path: str, source: str) -> dict:
    """The surface of a source. Never raises: what can't be read is unparsed, which is not the same as empty."""
    try:
        reader = Reader(path, Source(source))
        tests = reader.tests()
    except (SyntaxError, ValueError) as e:
        return _unparsed("python source has a syntax error" if isinstance(e, SyntaxError) or "null byte" in str(e) else f"{type(e).__name__}: {e}")
    except (RecursionError, MemoryError) as e:
        return _unparsed(f"{type(e).__name__}: {e}")
    framework = "unittest" if reader.unittest and not reader.pytest else "pytest"
    return {"status": "parsed", "language": "python", "framework": framework, "parse_ok": True, "parse_error": None, "tests": tests}


def _unparsed(error: str) -> dict:
    return {"status": "unparsed", "language": "python", "framework": None, "parse_ok": False, "parse_error": error, "tests": None}


def captures(source: str, kind: str) -> list[tuple[str, str, int]]:
    """(node kind, text, line) of every node of a kind of the syntax tree, in source order."""
    s = Source(source)
    wanted = getattr(ast, kind)
    nodes = [n for n in ast.walk(s.tree) if isinstance(n, wanted) and hasattr(n, "lineno")]
    return [(kind, s.written(n), n.lineno) for n in sorted(nodes, key=s.span)]
