"""Aligned assertions, resolved mocks, swallowed exceptions: the parts by themselves, then VID006 to VID008 over content pairs."""

from __future__ import annotations

import ast
import random
import textwrap

import pytest

from tessera.operators.alignment import ALIKE, SAME, pairs_of
from tessera.operators.control_flow import ends, taken
from tessera.operators.imports import handed_on, import_edges, imports_of, module_names
from tessera.operators.python_surface import extract
from tessera.plans.gate import gate
from tessera.schemas import CHANGESETS
from tessera.sources.pairs import from_pairs

PAIRS = "cs_id long, file_ord int, path string, kind string, base_path string, base_content string, head_content string, is_binary boolean"


def weight(base, head, pairs):
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    assert all(base[i][0] == head[j][0] for i, j in pairs)
    return sum(SAME if base[i] == head[j] else ALIKE for i, j in pairs)


def best(base, head):
    if not base or not head:
        return 0
    own = SAME if base[0] == head[0] else ALIKE if base[0][0] == head[0][0] else 0
    return max(best(base[1:], head), best(base, head[1:]), own and own + best(base[1:], head[1:]))


def test_alignment_is_the_heaviest_one():
    r = random.Random(5)
    for _ in range(150):
        sides = [[(k := r.choice("ab"), k + r.choice("12")) for _ in range(r.randrange(7))] for _ in range(2)]
        assert weight(*sides, pairs_of(*sides)) == best(*sides)
    # What is the same in all wins over what merely looks alike.
    assert pairs_of([("f", "f1"), ("f", "f2")], [("f", "f2"), ("f", "f3")]) == [(1, 0)]


def body(text):
    return ast.parse("def f():\n" + textwrap.indent(textwrap.dedent(text), "    ")).body[0].body


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("pass", {"next"}), ("raise", {"raise"}), ("return 1", {"return"}), ("if a:\n    raise\nelse:\n    raise X", {"raise"}), ("if a:\n    raise", {"next", "raise"}),
        ("for x in y:\n    raise", {"next", "raise"}), ("while True:\n    raise", {"raise"}), ("while True:\n    break", {"next"}), ("while True:\n    if a:\n        continue\n    raise", {"next", "raise"}), ("with a:\n    raise", {"raise"}),
        ("with suppress(Exception):\n    raise", {"next", "raise"}), ("try:\n    raise\nexcept A:\n    pass", {"next", "raise"}), ("try:\n    pass\nfinally:\n    return", {"return"}), ("try:\n    pass\nfinally:\n    raise", {"raise"}),
        ("match a:\n    case 1:\n        raise", {"next", "raise"}), ("assert False", {"raise"}), ("assert x", {"next", "raise"}), ("pytest.fail('x')", {"raise"}), ("pytest.skip('x')", {"return"}), ("def g():\n    raise", {"next"}), ("return\nraise", {"return"}),
    ],
)
def test_ends(text, expected):
    assert ends(body(text)) == expected


@pytest.mark.parametrize(
    ("text", "swallowed"),
    [
        ("try:\n    assert x\nexcept Exception:\n    pass", True), ("try:\n    assert x\nexcept ValueError:\n    pass", False), ("try:\n    assert x\nexcept:\n    raise", False), ("try:\n    assert x\nexcept (A, b.AssertionError):\n    log()", True),
        ("try:\n    assert x\nexcept AssertionError:\n    raise\nexcept Exception:\n    pass", False), ("try:\n    pass\nexcept Exception:\n    assert x", False), ("try:\n    pass\nexcept Exception:\n    pass\nelse:\n    assert x", False),
        ("try:\n    pass\nfinally:\n    assert x", False), ("try:\n    assert x\nfinally:\n    return", True), ("for a in b:\n    try:\n        assert x\n    finally:\n        continue", True), ("with contextlib.suppress(AssertionError):\n    if a:\n        assert x", True),
        ("with suppress(KeyError):\n    assert x", False), ("try:\n    try:\n        assert x\n    except KeyError:\n        pass\nexcept BaseException:\n    print(1)", True), ("try:\n    assert x\nexcept Exception:\n    if strict:\n        raise", True),
        ("try:\n    pytest.raises(E, f)\nexcept Exception:\n    pass", False), ("try:\n    pytest.raises(E, f)\nexcept BaseException:\n    pass", True), ("try:\n    self.assertEqual(a, b)\nexcept Exception:\n    pass", True), ("with pytest.raises(AssertionError):\n    f()", False),
        ("match a:\n    case 1:\n        try:\n            assert x\n        except Exception:\n            pass", True),
    ],
)
def test_swallowed(text, swallowed):
    found = extract("tests/test_a.py", "def test_a():\n" + textwrap.indent(text, "    ") + "\n")["tests"][0]["assertions"]
    assert [a["swallowed"] for a in found] == [swallowed]


def test_nested_functions_are_not_entered():
    assert taken(body("try:\n    def g():\n        assert x\nexcept Exception:\n    pass")) == {}


def test_literals():
    def literal(statement):
        return extract("t.py", f"def test_a():\n    {statement}\n")["tests"][0]["assertions"][0]["literal"]

    assert literal("assert f(1) == [1, -2, {'a': None}]") == [False, True] and literal("assert x == approx(1.5, abs=tol)") == [False, True] and literal("assert x == approx(y)") == [False, False]
    assert literal("assert f'{x}' in 'abc'") == [False, True] and literal("self.assertEqual(x, *y)") == [False, False] and literal("assert not 3") == [True] and literal("assert isinstance(x, int)") == [False, False]


def test_huge_numbers_and_deep_sources(spark):
    from tessera.operators.surfaces import capture_rows, extract_sources
    from tessera.sources.unified_diff import read_diffs

    deep = "x = " + "-" * 50_000 + "1\n"
    good = "@flaky(max_runs=3)\ndef test_a():\n    f()\n"
    rows = [(1, 0, "tests/test_a.py", "head", good), (2, 0, "tests/test_b.py", "head", good.replace("3", "9" * 11)), (3, 0, "tests/test_c.py", "head", deep)]
    sources = spark.createDataFrame(rows, "cs_id long, file_ord int, path string, side string, content string")
    got = {r["cs_id"]: r for r in extract_sources(sources).collect()}
    assert [got[i]["tests"][0]["retries"][0]["max_attempts"] for i in (1, 2)] == [3, None] and got[3]["status"] in ("parsed", "unparsed")
    assert {r["cs_id"] for r in capture_rows(sources, "FunctionDef").collect()} == {1, 2}
    diff = "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -{0} +1 @@\n-x\n+y\n"
    found = {r["cs_id"]: r["parse_error"] for r in read_diffs(spark.createDataFrame([(i, diff.format(n)) for i, n in enumerate(("1", "9" * 12, "9" * 5000, "1," + "9" * 10))], "cs_id long, raw string")).collect()}
    assert found[0] is None and all(found[i].startswith("malformed hunk header") for i in (1, 2, 3))


def test_imports():
    text = "import a.b\nimport a.b as c\nfrom . import d\nfrom ..e import f as g\nfrom h import *\ndef t():\n    from i import j\n"
    assert sorted(imports_of(text, "p.q")) == sorted([("a", "a"), ("c", "a.b"), ("d", "p.q.d"), ("g", "p.e.f"), ("j", "i.j")])
    assert imports_of("def (", "p") == [] and imports_of("from ... import x", "p") == [("x", "x")]


def test_module_names_and_hops(spark):
    df = spark.createDataFrame([("src/a/b.py",), ("a/__init__.py",), ("./lib/x.pyi",), ("__init__.py",)], "path string")
    assert [r[0] for r in df.select(module_names(df["path"])).collect()] == [["src.a.b", "a.b"], ["a"], ["lib.x", "x"], []]
    edges = spark.createDataFrame([(1, "a", "f", "b.g"), (1, "b", "g", "c.h"), (1, "c", "h", "a.f"), (2, "a", "f", "z.z")], "cs_id long, module string, name string, stands_for string")
    names = spark.createDataFrame([(1, "a.f.x")], "cs_id long, resolved string")
    assert {r["resolved"] for r in handed_on(names, edges, hops=5).collect()} == {"a.f.x", "b.g.x", "c.h.x"}


T = "tests/test_a.py"


def found(spark, rule_id, cases):
    """(line of the last evidence, its snippet) of one rule's findings, for each of many change sets in one plan; a case has files (path, base, head) and paths that change besides."""
    rows = [(k, i, p, "modified", None, b, h, False) for k, (files, changed) in enumerate(cases) for i, (p, b, h) in enumerate((*files, *((c, "x = 1\n", "x = 2\n") for c in changed)))]
    sets = spark.createDataFrame([(k, "b", "h", [], None) for k in range(len(cases))], CHANGESETS)
    got = gate(sets, from_pairs(spark.createDataFrame(rows, PAIRS).coalesce(1)), rules=(rule_id,)).findings.collect()
    return [sorted((r["evidence"][-1]["line"], r["evidence"][-1]["snippet"]) for r in got if r["cs_id"] == k) for k in range(len(cases))]


def test_of(*statements):
    return "def test_a():\n" + "".join(f"    {s}\n" for s in statements)


test_of.__test__ = False


LITERALS = [
    (["assert f(1) == 2"], ["assert f(1) == 3"], ("src/m.py",), [(2, "f(1) | 3")]),
    (["assert f(1) == 2"], ["assert f(1) == 3"], ("docs/m.md",), []),
    (["assert f(1) == 2"], ["assert f(1) == 3"], ("tests/test_b.py",), []),
    (["assert f(1) == 2"], ["assert f(2) == 3"], ("src/m.py",), []),
    (["assert f(1) == 2"], ["assert f(1) == x"], ("src/m.py",), []),
    (["assert f(1) == 2"], ["assert f(1) != 3"], ("src/m.py",), []),
    (["assert 1 == 1"], ["assert 1 == 2"], ("src/m.py",), []),
    (["assert f(1) == approx(1, abs=1)"], ["assert f(1) == approx(1, abs=2)"], ("src/m.py",), []),
    (["assert f(1) == 2", "assert f(1) == 5"], ["assert f(1) == 5", "assert f(1) == 7"], ("src/m.py",), []),
    (["assert f(1) == 2", "assert f(1) == 5"], ["assert f(1) == 3", "assert g()", "assert f(1) == 5"], ("src/m.py",), [(2, "f(1) | 3")]),
    (["self.assertEqual(f(), 'a')"], ["x = 1", "self.assertEqual(f(), 'b')"], ("src/m.py",), [(3, "f() | 'b'")]),
]


def test_expected_literals(spark):
    assert found(spark, "VID006", [([(T, test_of(*b), test_of(*h))], changed) for b, h, changed, _ in LITERALS]) == [x for *_, x in LITERALS]


MOCKS = [
    ("", "mock.patch('m.f')", True), ("", "mock.patch('src.m.f')", True), ("", "mock.patch('json.loads')", False), ("import m as n", "mock.patch.object(n, 'f')", True), ("from m import C", "mock.patch.object(C, 'f')", True),
    ("from pkg import f", "mock.patch('pkg.f')", True), ("from pkg import g as h", "monkeypatch.setattr(h, 'x', 1)", True), ("import other", "mock.patch.object(other, 'f')", False), ("", "mock.patch()", False), ("", "mock.patch('m')", False),
]
PACKAGE = ("src/pkg/__init__.py", "from m import f, g\n", "from m import f, g\n")


def test_mocks(spark):
    cases, expected = [], []
    for imports, mock, fires in MOCKS:
        base, head = f"{imports}\n{test_of('assert x')}", f"{imports}\n{test_of(mock, 'assert x')}"
        cases += [([(T, base, head), PACKAGE], ("src/m.py",)), ([(T, head, head), PACKAGE], ("src/m.py",)), ([(T, base, head), PACKAGE], ("docs/m.md",))]
        expected += [fires, False, False]
    assert [bool(x) for x in found(spark, "VID007", cases)] == expected


def test_swallowing(spark):
    plain, wrapped = test_of("assert f(1) == 2", "assert g()"), test_of("try:", "    assert f(1) == 2", "except Exception:", "    pass", "assert g()")
    sides = [(plain, wrapped), (wrapped, wrapped), (wrapped, plain), (plain, plain + "    try:\n        assert new()\n    except Exception:\n        pass\n"), (plain, "def test_a(:\n")]
    assert found(spark, "VID008", [([(T, *x)], ()) for x in sides]) == [[(3, "f(1) | 2")], [], [], [], []]


def test_edges_skip_what_cannot_be_read(spark):
    rows = [(1, 0, "src/a.py", "modified", None, "", "import b", False, None), (1, 1, "src/c.py", "modified", None, "", "def (", False, None), (1, 2, "d.py", "modified", None, "", None, False, None), (1, 3, "e.js", "modified", None, "", "import x", False, None)]
    from tessera.schemas import FILE_CHANGES

    got = sorted((r["module"], r["name"], r["stands_for"]) for r in import_edges(spark.createDataFrame(rows, FILE_CHANGES)).collect())
    assert got == [("a", "b", "b"), ("src.a", "b", "b")]
