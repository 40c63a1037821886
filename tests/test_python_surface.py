from __future__ import annotations

import pytest

from tessera.operators.python_surface import captures, extract


def one(body: str, head: str = "def test_it(self=None):", before: str = "") -> dict:
    source = f"{before}{head}\n" + "".join(f"    {line}\n" for line in body.splitlines())
    s = extract("t/test_m.py", source)
    assert s["status"] == "parsed", s
    return s["tests"][0]


def kinds(body: str) -> list[tuple]:
    return [(a["kind"], a["negated"], a["operands"]) for a in one(body)["assertions"]]


@pytest.mark.parametrize(
    ("statement", "expected"),
    [
        ("assert a == 1", ("equality", False, ["a", "1"])),
        ("assert a != b", ("equality", True, ["a", "b"])),
        ("assert a is b", ("identity", False, ["a", "b"])),
        ("assert a is None", ("existence", True, ["a", "None"])),
        ("assert a is not None", ("existence", False, ["a", "None"])),
        ("assert x in ys", ("membership", False, ["x", "ys"])),
        ("assert x not in ys", ("membership", True, ["x", "ys"])),
        ("assert a < b <= c", ("comparison", False, ["a", "b", "c"])),
        ("assert isinstance(a, int)", ("type", False, ["a", "int"])),
        ("assert not ready", ("truthiness", True, ["ready"])),
        ("assert not a == b", ("equality", True, ["a", "b"])),
        ("assert (a == b)", ("truthiness", False, ["(a == b)"])),
        ("assert (a) == (b +  c)", ("equality", False, ["(a)", "(b + c)"])),
        ("assert f(  x,\n      y), 'why'", ("truthiness", False, ["f( x, y)"])),
        ("self.assertEqual(a, b)", ("equality", False, ["a", "b"])),
        ("self.assertIsNone(a)", ("existence", True, ["a"])),
        ("self.assertFalse((a))", ("truthiness", True, ["(a)"])),
        ("self.assertRaises(E, f, *rest, **more)", ("exception", False, ["E", "f", "*rest", "**more"])),
        ("m.assert_called_once_with(1)", ("call", False, ["1"])),
        ("m.assert_any_call()", ("call", False, [])),
        ("self.fail('no')", ("custom", False, ["'no'"])),
        ("self.assertShape(a)", ("custom", False, ["a"])),
        ("with pytest.raises(E):\n    f()", ("exception", False, ["E"])),
    ],
)
def test_assertions(statement, expected):
    assert kinds(statement) == [expected]


@pytest.mark.parametrize(
    ("statement", "tolerance"),
    [("assert a == approx(1, abs=0.5)", 0.5), ("assert pytest.approx(1, rel=1e-3) == a", 1e-3), ("self.assertAlmostEqual(a, b, delta=-2)", -2.0), ("assert a == approx(1, abs=eps)", None), ("assert a == approx(1, abs=(0.5))", None)],
)
def test_tolerances(statement, tolerance):
    (a,) = one(statement)["assertions"]
    assert (a["kind"], a["tolerance"]) == ("approximate", tolerance)


def test_identity_lines_and_discovery():
    s = extract("p.py", "import pytest\n\n@pytest.mark.skip\n@other\ndef test_a():\n    pass\n\ndef _test_b(): pass\ndef helper(): pass\nclass TestC:\n    def test_d(self):\n        assert 1\n    def other(self): pass\nclass Helper:\n    def test_no(self): pass\nclass X(unittest.TestCase):\n    def testFoo(self): pass\n")
    assert [(t["id"], t["qualname"], t["line_start"], t["line_end"], t["is_discoverable"]) for t in s["tests"]] == [
        ("p.py::test_a", "test_a", 3, 6, True), ("p.py::_test_b", "_test_b", 8, 8, False), ("p.py::TestC::test_d", "TestC.test_d", 11, 12, True), ("p.py::X::testFoo", "X.testFoo", 17, 17, False),
    ]


@pytest.mark.parametrize(
    ("source", "framework"),
    [("", "pytest"), ("class A(TestCase):\n    def test_a(self): self.assertTrue(1)\n", "unittest"), ("import pytest\nclass A(TestCase):\n    pass\n", "pytest"), ("class TestA(b.TestCase):\n    def test_a(self):\n        assert 1\n", "pytest"), ("class A(metaclass=TestCase):\n    pass\n", "pytest")],
)
def test_framework(source, framework):
    s = extract("a.py", source)
    assert (s["framework"], s["parse_ok"]) == (framework, True)


def test_markers_retries_and_mocks():
    decorators = "@pytest.mark.skipif(a  >  b, reason='x')\n@pytest.mark.xfail\n@unittest.skipIf(c, 'y')\n@unittest.skip('z')\n@expectedFailure\n@pytest.mark.flaky(reruns=3)\n@pytest.mark.repeat(4)\n@flaky(5)\n@flaky(max_runs=n)\n@mock.patch('pkg.fn')\n@patch.object(Foo, 'bar')\n@benchmark.skip\n"
    t = one("monkeypatch.setattr(obj, name, 1)\nmonkeypatch.setattr('a.b', 2)\npatch.dict(env)\npytest.skip('later')\nmock.patch('a' 'b')\nrun(__init__(), x.y())", before=decorators)
    assert [(m["reason"], m["expression"]) for m in t["skip_markers"]] == [("skip_if", "a > b"), ("expected_failure", None), ("skip_if", "c"), ("skip", None), ("expected_failure", None), ("skip", None), ("skip", None)]
    assert [(r["callee"], r["max_attempts"]) for r in t["retries"]] == [("flaky", 3), ("repeat", 4), ("flaky", 5), ("flaky", None)]
    assert [m["target"] for m in t["mocks"]] == ["pkg.fn", "Foo.bar", "obj.name", "a.b", "env", "'a' 'b'"]
    assert t["exercised_symbols"] == ["run", "y"]


def test_nested_scopes_are_their_own():
    t = one("def inner():\n    assert 1\n    f()\n@deco(g())\nclass C:\n    x = h()\nk = lambda: m()\nassert all(p(x) for x in q())")
    assert len(t["assertions"]) == 1 and t["exercised_symbols"] == ["all", "deco", "g", "m", "p", "q"]


def test_a_call_in_an_assert_counts_too():
    assert [a["kind"] for a in one("assert m.assert_called()")["assertions"]] == ["truthiness", "call"]


@pytest.mark.parametrize("source", ["def test_a(:\n", "def(", "\x00", "((((((((", "print 'two'\n", "é" * 5000 + " ="])
def test_never_raises(source):
    s = extract("a.py", source)
    assert (s["status"], s["tests"], s["parse_ok"]) == ("unparsed", None, False) and s["parse_error"]


@pytest.mark.parametrize("source", ["", "\n\n  \n", "# only a comment", "x = 1\r\ny = 2\r\n"])
def test_empty_is_parsed(source):
    assert extract("a.py", source)["tests"] == []


def test_unicode_and_crlf_columns():
    assert one("assert 'é' + naïve == \"日本\"")["assertions"][0]["operands"] == ["'é' + naïve", '"日本"']
    s = extract("a.py", "def test_a():\r\n    assert (a\r\n            ) == b\r\n")
    assert s["tests"][0]["assertions"][0]["operands"] == ["(a )", "b"]


def test_captures():
    assert captures("a(b(1))\nc()\n", "Call") == [("Call", "a(b(1))", 1), ("Call", "b(1)", 1), ("Call", "c()", 2)]
