"""Changes derived from the tables that go through every branch of the readers: kinds of diff sections, classes and methods of test modules, repeated test ids, list settings of JavaScript and coverage tools."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.derived import _change, _changes, _keys, _pick, _text


class Section(NamedTuple):
    """A diff, with what is to be read from it; {k} stands for the order's key."""

    raw: str
    path: str | None = None
    kind: str | None = None
    base_path: str | None = None
    binary: bool | None = None
    hunks: int | None = None
    added: int | None = None
    removed: int | None = None
    error: str | None = None


_GIT = "diff --git a/{p} b/{p}\n"
_ONE = "@@ -1 +1 @@\n-old\n+new\n"


def _git(path: str, rest: str) -> str:
    return _GIT.replace("{p}", path) + rest


SECTIONS = (
    Section(_git("s/n{k}.py", "new file mode 100644\n--- /dev/null\n+++ b/s/n{k}.py\n@@ -0,0 +1,2 @@\n+a\n+b\n"), "s/n{k}.py", "added", None, False, 1, 2, 0),
    Section(_git("s/d{k}.py", "deleted file mode 100644\n--- a/s/d{k}.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"), "s/d{k}.py", "deleted", None, False, 1, 0, 2),
    Section("diff --git a/o{k} b/r{k}\nsimilarity index 100%\nrename from o{k}\nrename to r{k}\n", "r{k}", "renamed", "o{k}", False, 0, 0, 0),
    Section("diff --git a/o {k} b/r {k}\nsimilarity index 90%\nrename from o {k}\nrename to r {k}\n--- a/o {k}\t\n+++ b/r {k}\t\n" + _ONE, "r {k}", "renamed", "o {k}", False, 1, 1, 1),
    Section(_git("p{k}.png", "index 1..2 100644\nBinary files a/p{k}.png and b/p{k}.png differ\n"), "p{k}.png", "modified", None, True, 0, 0, 0),
    Section(_git("q{k}.bin", "index 1..2 100644\nGIT binary patch\nliteral 3\nKcmZ\n\nliteral 4\nLcmZ\n"), "q{k}.bin", "modified", None, True, 0, 0, 0),
    Section('diff --git "a/caf\\303\\251{k}.py" "b/caf\\303\\251{k}.py"\n--- "a/caf\\303\\251{k}.py"\n+++ "b/caf\\303\\251{k}.py"\n' + _ONE, "café{k}.py", "modified", None, False, 1, 1, 1),
    Section(_git("my tool {k}", "old mode 100644\nnew mode 100755\n"), "my tool {k}", "modified", None, False, 0, 0, 0),
    Section('diff --git "a/t\\t{k}" "b/t\\t{k}"\nold mode 100644\nnew mode 100755\n', "t\t{k}", "modified", None, False, 0, 0, 0),
    Section(_git("e{k}", "--- a/e{k}\n+++ b/e{k}\n@@ -1,2 +1,2 @@\n \n-x\n\\ No newline at end of file\n+y\n\\ No newline at end of file\n@@ -9 +9,0 @@\n-z\n"), "e{k}", "modified", None, False, 2, 1, 2),
    Section(_git("new{k}.png", "new file mode 100644\nindex 0..2\nBinary files /dev/null and b/new{k}.png differ\n"), "new{k}.png", "added", None, True, 0, 0, 0),
    Section("hello {k}\n", error="expected a 'diff --git' header, found: 'hello {k}'"),
    Section(_git("b{k}", "--- a/b{k}\n+++ b/b{k}\n@@ -1 +1\n"), error="malformed hunk header: '@@ -1 +1'"),
    Section(_git("b{k}", "+stray {k}\n"), error="hunk content line outside of any hunk: '+stray {k}'"),
    Section("diff --git a/o{k} b/r{k}\nrename from o{k}\n", error="rename header missing 'from' or 'to' path: 'diff --git a/o{k} b/r{k}'"),
    Section(_git("p{k}", "Binary files {k} differ\n"), error="malformed binary-file header: 'Binary files {k} differ'"),
    Section(_git("b{k}", "--- a/b{k}\n+++ b/b{k}\n@@ -1 +1 @@\n-a\n?b{k}\n"), error="malformed hunk line: '?b{k}'"),
    Section(_git("b{k}", "--- a/b{k}\n+++ b/b{k}\n@@ -1,3 +{k},3 @@\n a\n"), error="the hunk at -1,3 +{k},3 ended before its declared line counts were satisfied"),
    Section("diff --git {k}\nnew file mode 100644\n", error="added file section has no path: 'diff --git {k}'"),
)


def sections(orders: DataFrame) -> DataFrame:
    """A diff (cs_id, raw) of one of SECTIONS for each order."""
    k = F.col("o_orderkey")
    return orders.select(k.alias("cs_id"), F.replace(_pick([s.raw for s in SECTIONS], k % len(SECTIONS)), F.lit("{k}"), k.cast("string")).alias("raw"))


#: By digits of the customer: names and bases of a class, its method, and the method's body with the kind, operands, tolerance, target of a mock and called names to be read from it.
CLASSES = ("TestThing", "Helper", "ThingTests")
BASES = ("", "(unittest.TestCase)", "(metaclass=TestCase)")
METHODS = ("test_m", "_test_m", "testm", "check_m")
BODIES = (
    ("        self.assertEqual(f({k}), 2)\n", "equality", "f({k})|2", None, "", "f"),
    ("        self.assertAlmostEqual(f(), 1.5, delta=0.25)\n", "approximate", "f()|1.5", 0.25, "", "f"),
    ("        assert f() > {k}\n", "comparison", "f()|{k}", None, "", "f"),
    ("        m.assert_called_once_with({k})\n", "call", "{k}", None, "", ""),
    ("        with mock.patch.object(a, 'b{k}') as p:\n            p.start()\n", "", "", None, "a.b{k}", "start"),
)


def class_sources(customers: DataFrame) -> DataFrame:
    """A test module for each customer: a function, and a class with one method, skipped for every second one, with a nested function that isn't looked into."""
    k = F.col("c_custkey")

    def digit(of: int, values) -> Column:
        return F.replace(_pick(values, F.floor(k / of) % len(values)), F.lit("{k}"), k.cast("string"))

    content = _text(
        "import unittest\n\n\ndef test_top():\n    load(", k.cast("string"), ")\n\n\nclass ", digit(1, CLASSES), digit(3, BASES), ":\n", F.when(k % 2 == 1, "    @unittest.skip('x')\n").otherwise(""),
        "    def ", digit(9, METHODS), "(self):\n", digit(36, [b[0] for b in BODIES]), "        def inner():\n            assert hidden\n",
    )
    return _keys(customers).select(k.alias("cs_id"), F.lit(0).alias("file_ord"), _text("tests/test_k", k.cast("string"), ".py").alias("path"), F.lit("head").alias("side"), content.alias("content"))


def repeated_tests(lineitem: DataFrame) -> DataFrame:
    """Tests in the order of an order's lines, two ids for all of them: rows as pairing reads them, with the part as what differs."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lineitem.select(
        F.col("l_orderkey").alias("cs_id"), F.lit("tests/test_a.py").alias("path"), F.lit("base").alias("side"), F.concat(F.lit("t"), (F.col("l_partkey") % 2).cast("string")).alias("test_id"),
        (F.row_number().over(order) - 1).alias("test_ord"), F.col("l_partkey").alias("part"),
    )


#: Items of a list and the divisor whose multiples lack them; whether they look like tests.
ITEMS = (("tests/a", 2, True), ("build", 3, False), ("spec_b", 5, True), ("lib/x_test.py", 7, True))
#: Settings of both files, in the order of their lines: key, letter before its items, salt of the base.
JS_LISTS = (("testPathIgnorePatterns", "p", 0), ("exclude", "e", 4), ("testMatch", "m", 2))
COVERAGE_LISTS = (("omit", "o", 0), ("exclude_lines", "x", 2))


def tool_lists(customers: DataFrame) -> DataFrame:
    """Both contents of a jest.config.js for even customers, of a .coveragerc for odd ones."""
    k = F.col("c_custkey")

    def items(letter: str, salt: int) -> Column:
        return F.concat_ws(", ", *[F.when((k + salt) % m != 0, F.lit(f'"{letter}/{name}"')) for name, m, _ in ITEMS])

    def content(later: int) -> Column:
        js = _text("module.exports = {\n", *[x for key, letter, salt in JS_LISTS for x in (f"  {key}: [", items(letter, salt + later), "],\n")], "};\n")
        return F.when(k % 2 == 0, js).otherwise(_text("[run]\n", *[x for key, letter, salt in COVERAGE_LISTS for x in (f"{key} =\n    [", items(letter, salt + later), "\n    ]\n")]))

    path = F.when(k % 2 == 0, "jest.config.js").otherwise(".coveragerc")
    return _changes(customers, _change(path, content(0), content(1), F.lit(True)))
