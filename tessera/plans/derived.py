"""Change sets derived from the star-schema tables by plain column arithmetic, so that SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dealing import dealt
from tessera.functions.lines import lines_of
from tessera.schemas import HUNKS, STRENGTH

PATHS = (
    ".github/workflows/ci.yml", ".github/workflows/release.yaml", "pyproject.toml", "setup.cfg", "tox.ini", ".coveragerc", "pytest.ini", "mypy.ini",
    "jest.config.js", "vitest.config.ts", "package.json", "Makefile", ".pre-commit-config.yaml", "src/app.py", "docs/pyproject.toml", "README.md",
)
TRAILER = "Gate-Justification"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _orders(orders: DataFrame) -> DataFrame:
    """What change sets are derived of, in even tasks by key: lines, findings and scores of a change set stay where its key was dealt."""
    return dealt(orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


def config_corpus(orders: DataFrame) -> DataFrame:
    """A change set for each order: one configuration file with one edited setting, for every eleventh order a second edit of it."""
    return _order_files(orders, _config_change())


def flag_corpus(orders: DataFrame) -> DataFrame:
    """A change set for each order: one command line that gained, lost or kept a flag."""
    return _order_files(orders, _flag_change())


def gate_corpus(orders: DataFrame) -> DataFrame:
    """Both files in one change set for each order, in one pass over the orders, a row for each file."""
    return whole_files(_order_files(orders, _config_change(), _flag_change()))


def whole_files(files: DataFrame) -> DataFrame:
    """Files without contents, the hunks of rows of one file in one row: orders of one key are one change set."""
    none = F.lit(None).cast("string")
    hunks = files.groupBy("cs_id", "file_ord", "path").agg(F.flatten(F.collect_list("hunks")).alias("hunks"))
    return hunks.select("cs_id", "file_ord", "path", F.lit("modified").alias("kind"), none.alias("base_path"), none.alias("base_content"), none.alias("head_content"), F.lit(False).alias("is_binary"), "hunks")


def _config_change() -> Column:
    k = F.col("o_orderkey")
    base = F.floor("o_totalprice").cast("long") % 100
    head = (base * 7 + F.col("o_custkey")) % 100

    def line(v: Column) -> Column:
        shape = k % 7
        out = F.when(shape == 0, F.concat(F.lit("fail_under = "), v)).when(shape == 1, F.concat(F.lit("addopts = --cov-fail-under="), v)).when(shape == 2, F.concat(F.lit("  lines: "), v, F.lit(",")))
        return out.when(shape == 3, F.concat(F.lit("    timeout-minutes: "), v)).when(shape == 4, F.concat(F.lit("run: pytest --timeout="), v)).when(shape == 5, F.concat(F.lit("  testTimeout: "), v, F.lit("000"))).otherwise(F.concat(F.lit("Fail-Under: "), v, F.lit(".5")))

    def one(n: Column, v: Column) -> Column:
        return F.struct(n.cast("int").alias("line"), line(v.cast("string")).alias("text"))

    at = (F.col("o_custkey") % 40) + 1
    twice = k % 11 == 0
    removed = F.when(twice, F.array(one(at, base), one(at + 1, base + 1))).otherwise(F.array(one(at, base)))
    added = F.when(twice, F.array(one(at, head), one(at + 1, head + 1))).otherwise(F.array(one(at, head)))
    return _edit(_pick(PATHS, k % 16), at, removed, added)


def _flag_change() -> Column:
    k = F.col("o_orderkey")
    shape = (F.col("o_custkey") + k) % 12
    tail = F.concat(F.lit(" job"), (k % 5).cast("string"))
    was = F.when(shape == 9, "strict = true").when(shape == 10, F.lit("strict = False")).otherwise(F.concat(F.lit("  make check"), tail))
    now = (
        F.when(shape == 0, F.concat(F.lit("git commit --no-verify"), tail)).when(shape == 1, F.concat(F.lit("HUSKY=0 git push --no-validate"), tail))
        .when(shape == 2, F.concat(F.lit("flake8 --exit-zero"), tail)).when(shape == 3, F.concat(F.lit("continue-on-error: TRUE"), F.lit("")))
        .when(shape == 4, F.concat(F.lit("  make check"), tail, F.lit(" || true"))).when(shape == 5, F.concat(F.lit("make other"), tail, F.lit(" || true")))
        .when(shape == 6, F.concat(F.lit("--ignore=tests/unit/t"), (k % 9).cast("string"))).when(shape == 7, F.concat(F.lit("addopts = --ignore=build --ignore=spec/x"), (k % 9).cast("string")))
        .when(shape == 8, F.concat(F.lit("pkg/tests/test_"), (k % 9).cast("string"), F.lit(".py"))).when(shape == 9, F.lit("  STRICT = false")).when(shape == 10, F.lit("strict = true")).otherwise(F.concat(F.lit("# note"), tail))
    )
    path = F.when(shape.isin(6, 7), _pick(("pytest.ini", "tox.ini", "a/b/conftest.py", "other.txt"), k % 4)).when(shape == 8, _pick((".gitignore", "pkg/.gitignore", "notes.txt"), k % 3)).otherwise(_pick(PATHS, k % 16))
    at = (k % 30) + 1
    return _edit(path, at, F.array(F.struct(at.cast("int").alias("line"), was.alias("text"))), F.array(F.struct(at.cast("int").alias("line"), now.alias("text"))))


def _edit(path: Column, at: Column, removed: Column, added: Column) -> Column:
    hunk = F.struct(at.cast("int").alias("base_start"), F.size(removed).alias("base_lines"), at.cast("int").alias("head_start"), F.size(added).alias("head_lines"), added.alias("added"), removed.alias("removed"))
    return F.struct(path.alias("path"), F.array(hunk).cast(HUNKS).alias("hunks"))


def _order_files(orders: DataFrame, *changes: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    # Made as columns, in compiled code; a generator's own expressions aren't compiled.
    names = [f"f{i}" for i in range(len(changes))]
    rows = _orders(orders).select(F.col("o_orderkey").alias("cs_id"), *[c.alias(n) for n, c in zip(names, changes, strict=True)]).select("cs_id", F.posexplode(F.array(*names)).alias("file_ord", "f"))
    return rows.select("cs_id", "file_ord", "f.path", F.lit("modified").alias("kind"), none.alias("base_path"), none.alias("base_content"), none.alias("head_content"), F.lit(False).alias("is_binary"), "f.hunks")


def retry_corpus(orders: DataFrame) -> DataFrame:
    """A workflow for each order: a retry action in line 20 and a test runner at a varying distance."""
    k = F.col("o_orderkey")
    runner = F.col("o_custkey") % 45
    lines = F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: F.when(i == 19, F.lit("      uses: nick-fields/retry@v3")).when(i == runner, F.lit("          command: npm run test")).otherwise(F.concat(F.lit("  step "), i.cast("string"))))
    added = F.array(F.struct(F.lit(20).alias("line"), F.lit("      uses: nick-fields/retry@v3").alias("text")))
    hunk = F.struct(F.lit(20).alias("base_start"), F.lit(0).alias("base_lines"), F.lit(20).alias("head_start"), F.lit(1).alias("head_lines"), added.alias("added"), F.expr("cast(array() as array<struct<line:int,text:string>>)").alias("removed"))
    return _orders(orders).select(
        k.alias("cs_id"), F.lit(0).alias("file_ord"), F.lit(".github/workflows/ci.yml").alias("path"), F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("base_path"),
        F.lit(None).cast("string").alias("base_content"), F.array_join(lines, "\n").alias("head_content"), F.lit(False).alias("is_binary"), F.array(hunk).cast(HUNKS).alias("hunks"),
    )


def _keys(customers: DataFrame) -> DataFrame:
    """The keys of customers in even tasks: all that is derived of one is made where its key was dealt."""
    return dealt(customers.select("c_custkey"), "c_custkey")


def list_corpus(customers: DataFrame) -> DataFrame:
    """Both contents of a pytest.ini for each customer, with list settings in three shapes."""
    k = F.col("c_custkey")

    def items(salt: int) -> Column:
        return F.concat_ws(", ", *[F.when((k + salt) % m != 0, F.lit(f'"{name}"')) for m, name in ((2, "tests/a"), (3, "build"), (5, "spec_b"), (7, "lib/test_c.py"))])

    def content(salt: int) -> Column:
        array = F.concat(F.lit("["), items(salt), F.lit("]"))
        broken = F.when(k % 13 == salt, F.concat(F.lit("["), items(salt))).otherwise(array)
        return F.concat(F.lit("[pytest]\nnorecursedirs = "), array, F.lit("\ntestpaths =\n  "), broken, F.lit("\ncollect_ignore: "), F.concat_ws(" ", F.lit("tests/x"), F.when((k + salt) % 4 != 0, F.lit("tests/y"))), F.lit("\n"))

    return _keys(customers).select(
        k.alias("cs_id"), F.lit(0).alias("file_ord"), F.lit("pytest.ini").alias("path"), F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("base_path"),
        content(0).alias("base_content"), content(1).alias("head_content"), F.lit(False).alias("is_binary"), F.expr(f"cast(array() as {HUNKS})").alias("hunks"),
    )


def surface_corpus(lineitem: DataFrame) -> DataFrame:
    """Surfaces of both sides: a file for each order, a test for each line number, an assertion for each row. Rows returned (R) are gone from the head, some accepted ones (A) are new in it."""
    kinds = tuple(STRENGTH)
    k = F.col("l_partkey") % 13
    # Bare columns are dealt once, by order; all that follows stays where its order is.
    rows = dealt(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"), "l_orderkey")

    def assertion(kind: Column) -> Column:
        return F.struct(
            _pick(kinds, kind).alias("kind"), F.lit("assert").alias("callee"), (F.col("l_partkey") % 97 + 1).cast("int").alias("line"),
            F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("operands"), F.lit(None).cast("double").alias("tolerance"), F.lit(False).alias("negated"),
        )

    of_base, of_head = F.expr("l_returnflag <> 'A' or l_suppkey % 7 <> 0"), F.expr("l_returnflag <> 'R'")
    sides = (("base", of_base, k), ("head", of_head, F.when(F.col("l_suppkey") % 5 == 0, (k + 3) % 13).otherwise(k)))
    skip = ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 0)).cast("int")
    made = [c for side, there, kind in sides for c in (F.array_sort(F.collect_list(F.when(there, assertion(kind)))).alias(f"{side}_a"), F.max(F.when(there, skip)).alias(f"{side}_s"))]
    each = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_a").alias("assertions"), F.col(f"{side}_s").alias("skip")) for side, _, _ in sides]))
    path = F.concat(F.lit("tests/test_o"), F.col("cs_id").cast("string"), F.lit(".py"))
    tests = rows.groupBy(F.col("l_orderkey").alias("cs_id"), "l_linenumber").agg(*made).select("cs_id", "l_linenumber", path.alias("path"), each.alias("s")).select("cs_id", "path", "l_linenumber", "s.*").where(F.size("assertions") > 0)
    name = F.concat(F.lit("test_l"), F.col("l_linenumber").cast("string"))
    none = F.expr("cast(array() as array<struct<reason:string,line:int,expression:string>>)")
    marker = F.array(F.struct(F.lit("skip").alias("reason"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("expression")))
    test = F.struct(
        F.concat_ws("::", "path", name).alias("id"), name.alias("name"), name.alias("qualname"), (F.col("l_linenumber") * 10).cast("int").alias("line_start"), (F.col("l_linenumber") * 10 + 5).cast("int").alias("line_end"),
        F.lit(True).alias("is_discoverable"), F.col("assertions"), F.when(F.col("skip") == 1, marker).otherwise(none).alias("skip_markers"),
        F.expr("cast(array() as array<struct<target:string,line:int,callee:string>>)").alias("mocks"), F.expr("cast(array() as array<struct<callee:string,line:int,max_attempts:int>>)").alias("retries"), F.expr("cast(array() as array<string>)").alias("exercised_symbols"),
    )
    return tests.select("cs_id", "path", "side", "l_linenumber", test.alias("t")).groupBy("cs_id", F.lit(0).alias("file_ord"), "path", "side").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))).alias("x")).select(
        "cs_id", "file_ord", "path", "side", F.lit("parsed").alias("status"), F.lit("python").alias("language"), F.lit("pytest").alias("framework"), F.lit(True).alias("parse_ok"), F.lit(None).cast("string").alias("parse_error"), F.transform("x", lambda e: e["t"]).alias("tests")
    )


def text_corpus(documents: DataFrame) -> DataFrame:
    """Both sides of each document as a file: the head lacks every line with (doc_id + line) % 7 = 0."""
    lines = lines_of(F.col("text"))
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: (F.col("doc_id") + s["i"] + 1) % 7 != 0)
    head = F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    return documents.select(
        F.col("doc_id").alias("cs_id"), F.lit(0).alias("file_ord"), F.concat("source", F.lit("/"), "lang", F.lit("/test_"), F.col("doc_id").cast("string"), _pick((".py", ".ts", ".js", ".txt", ".pyi", ".spec.tsx"), F.col("doc_id") % 6)).alias("path"),
        F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("base_path"), F.col("text").alias("base_content"), head.alias("head_content"), F.lit(False).alias("is_binary"),
    )


def document_diffs(documents: DataFrame) -> DataFrame:
    """A unified diff (cs_id, raw) for each document, one hunk over its whole text: lines with (doc_id + line) % 7 = 0 are gone, others with (doc_id + line) % 11 = 0 are followed by a note."""
    k = F.col("doc_id")
    at = F.transform(lines_of(F.coalesce(F.col("text"), F.lit(""))), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"), F.when((k + i + 1) % 7 == 0, "-").when((k + i + 1) % 11 == 0, "+").otherwise(" ").alias("what")))

    def many(lines: Column, *what: str) -> Column:
        return F.size(F.filter(lines, lambda s: s["what"].isin(*what))).cast("string")

    def shown(s: Column) -> Column:
        return F.when(s["what"] == "+", F.concat(F.lit(" "), s["x"], F.lit("\n+note "), s["n"].cast("string"))).otherwise(F.concat(s["what"], s["x"]))

    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/test_"), k.cast("string"), _pick((".py", ".ts", ".js", ".txt", ".pyi", ".spec.tsx"), k % 6))
    rows = documents.select(k.alias("cs_id"), path.alias("path"), at.alias("lines"))
    lines = F.col("lines")
    after = F.size(F.filter(lines, lambda s: s["what"] != "-")) + F.size(F.filter(lines, lambda s: s["what"] == "+"))
    hunk = F.concat(F.lit("@@ -1,"), many(lines, " ", "-", "+"), F.lit(" +1,"), after.cast("string"), F.lit(" @@\n"), F.array_join(F.transform(lines, shown), "\n"), F.lit("\n"))
    head = F.concat(F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"), F.lit("\n--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"), F.lit("\n"))
    return rows.select("cs_id", F.when(F.size("lines") > 0, F.concat(head, hunk)).otherwise(head).alias("raw"))


def diff_texts(orders: DataFrame) -> DataFrame:
    """A unified diff for each order: one modified file, an edited line between two of context; every seventh ends too early."""
    k = F.col("o_orderkey")
    at = (k % 50 + 1).cast("string")
    cut = k % 7 == 0
    raw = F.concat(
        F.lit("diff --git a/src/m"), k.cast("string"), F.lit(".py b/src/m"), k.cast("string"), F.lit(".py\nindex 1..2 100644\n--- a/src/m"), k.cast("string"), F.lit(".py\n+++ b/src/m"), k.cast("string"),
        F.lit(".py\n@@ -"), at, F.lit(",3 +"), at, F.lit(",3 @@ def f():\n before\n-old "), F.col("o_custkey").cast("string"), F.lit("\n+new "), F.col("o_custkey").cast("string"), F.when(cut, "\n").otherwise("\n after\n"),
    )
    return orders.select(k.alias("cs_id"), raw.alias("raw"))


def source_texts(customers: DataFrame) -> DataFrame:
    """A test module for each customer."""
    k = F.col("c_custkey")
    content = F.concat(
        F.lit("import pytest\n\n\ndef test_balance():\n    value = load("), k.cast("string"), F.lit(")\n    assert value == "), k.cast("string"), F.lit("\n    assert value is not None\n\n\n@pytest.mark.skip\ndef test_segment():\n    assert check("),
        (k % 7).cast("string"), F.lit(") in ["), (k % 3).cast("string"), F.lit("]\n"),
    )
    return _keys(customers).select(k.alias("cs_id"), F.lit(0).alias("file_ord"), F.concat(F.lit("tests/test_c"), k.cast("string"), F.lit(".py")).alias("path"), F.lit("head").alias("side"), content.alias("content"))


#: What a change does to a test module, by customer modulo 12: the base's and the head's body of test_case, and decorators of the head.
CASES = (
    ("    assert value == 1\n    assert value is not None\n", None, ""),
    ("    assert value == 1\n    assert other == 2\n", "    assert value == 1\n", ""),
    ("    assert value == 1\n    assert value == 1\n", "    assert value == 1\n", ""),
    ("    assert value == 1\n", "    assert value == 1\n", "@pytest.mark.skip\n"),
    ("    assert value == approx(1, abs=0.1)\n", "    assert value == approx(1, abs=0.5)\n", ""),
    ("    assert value == 1\n", "    assert value == approx(1)\n", ""),
    ("    assert value == 1\n", "    assert value\n", ""),
    ("    assert value == 1\n", "    assert value == 1\n", "@pytest.mark.flaky(reruns=3)\n"),
    ("    assert value == 1\n", "    assert value == 1\n    assert other in [2]\n", ""),
    ("    assert value == 1\n", "    assert (value ==\n", ""),
    ("    with pytest.raises(E):\n        run()\n", "    with pytest.raises(E):\n        run()\n", "@unittest.skipIf(slow, 'x')\n"),
    ("    assert value == 1\n", "    assert value == 1\n", ""),
)


def module_pairs(customers: DataFrame) -> DataFrame:
    """Two files for each customer: a test module whose test_case changes as CASES says (0: it is gone, 9: the head can't be parsed), and code with one new line."""
    k = F.col("c_custkey")
    shape = k % len(CASES)
    head = F.lit("import pytest\n\n\ndef test_other():\n    assert check(1)\n")
    name = F.lit("\n\ndef test_case():\n    value = load()\n")
    base = F.concat(head, name, _pick([b for b, _, _ in CASES], shape))
    after = F.when(shape == 0, head).otherwise(F.concat(head, F.lit("\n\n"), _pick([d for _, _, d in CASES], shape), F.lit("def test_case():\n    value = load()\n"), _pick([h or "" for _, h, _ in CASES], shape)))
    empty = F.expr(f"cast(array() as {HUNKS})")
    test = F.struct(F.lit(0).alias("file_ord"), F.concat(F.lit("tests/test_m"), k.cast("string"), F.lit(".py")).alias("path"), base.alias("base_content"), after.alias("head_content"), empty.alias("hunks"))
    added = F.array(F.struct(F.lit(7).alias("line"), F.concat(F.lit("x = "), k.cast("string")).alias("text")))
    hunk = F.struct(F.lit(6).alias("base_start"), F.lit(0).alias("base_lines"), F.lit(7).alias("head_start"), F.lit(1).alias("head_lines"), added.alias("added"), F.expr("cast(array() as array<struct<line:int,text:string>>)").alias("removed"))
    none = F.lit(None).cast("string")
    code = F.struct(F.lit(1).alias("file_ord"), F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")).alias("path"), none.alias("base_content"), none.alias("head_content"), F.array(hunk).cast(HUNKS).alias("hunks"))
    rows = _keys(customers).select(k.alias("cs_id"), F.explode(F.array(test, code)).alias("f"))
    return rows.select("cs_id", "f.file_ord", "f.path", F.lit("modified").alias("kind"), none.alias("base_path"), "f.base_content", "f.head_content", F.lit(False).alias("is_binary"), "f.hunks")


def _change(path: Column, base: Column, head: Column, touched: Column) -> Column:
    """A modified file with both contents; where it is touched, its head's first line is a changed one."""
    line = F.array(F.struct(F.lit(1).alias("line"), F.lit("# changed").alias("text")))
    none = F.expr("cast(array() as array<struct<line:int,text:string>>)")
    hunk = F.array(F.struct(F.lit(0).alias("base_start"), F.lit(0).alias("base_lines"), F.lit(1).alias("head_start"), F.lit(1).alias("head_lines"), line.alias("added"), none.alias("removed"))).cast(HUNKS)
    return F.struct(path.alias("path"), base.alias("base_content"), head.alias("head_content"), F.when(touched, hunk).otherwise(F.expr(f"cast(array() as {HUNKS})")).alias("hunks"))


def _changes(customers: DataFrame, *changes: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = _keys(customers).select(F.col("c_custkey").alias("cs_id"), F.posexplode(F.array(*changes)).alias("file_ord", "f"))
    return rows.select("cs_id", "file_ord", "f.path", F.lit("modified").alias("kind"), none.alias("base_path"), "f.base_content", "f.head_content", F.lit(False).alias("is_binary"), "f.hunks")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def expectation_pairs(customers: DataFrame) -> DataFrame:
    """A test of up to six assertions on f(i) for each customer: some are dropped, some are new, others of g come between, some expect one more; two of three change sets touch code too."""
    k = F.col("c_custkey")

    def body(head: bool) -> Column:
        def lines(i: Column) -> Column:
            value = (k * 7 + i) % 10 + (F.when((k + i) % 4 == 0, 1).otherwise(0) if head else 0)
            own = F.when((k + i) % 7 != 1 if head else (k + i) % 5 != 4, _text("    assert f(", i.cast("string"), ") == ", value.cast("string"), "\n"))
            between = F.when((k + i) % 6 == 2, _text("    assert g(", i.cast("string"), ") == 0\n")) if head else F.lit(None).cast("string")
            return F.concat_ws("", between, own)

        return _text("import pytest\n\n\ndef test_values():\n", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lines), ""), "    assert done\n")

    name = k.cast("string")
    other = F.when(k % 3 != 0, _text("src/m", name, ".py")).otherwise(_text("docs/m", name, ".md"))
    none = F.lit(None).cast("string")
    return _changes(customers, _change(_text("tests/test_e", name, ".py"), body(False), body(True), F.lit(True)), _change(other, none, none, F.lit(True)))


#: How the head of a test module replaces something, by customer modulo 6: imports, and a line of test_run.
MOCKS = (
    ("import pkg.mod as m\n", "    with mock.patch.object(m, 'run'):\n        pass\n"),
    ("from pkg import run as go\n", "    mock.patch('pkg.run')\n"),
    ("import os\n", "    mock.patch('os.path.join')\n"),
    ("from pkg import mod\n", "    mock.patch('pkg.mod.old')\n"),
    ("from pkg import mod as m\n", "    monkeypatch.setattr(m, 'run', fake)\n"),
    ("import pkg.mod\n", "    mock.patch('pkg.mod.run')\n"),
)


def mock_pairs(customers: DataFrame) -> DataFrame:
    """A test module for each customer that gains a mock as MOCKS says (3: the base has it too), a package that hands `run` on, and its module, touched but for every fourth customer."""
    k = F.col("c_custkey")
    top = F.concat(F.lit("from unittest import mock\n"), _pick([i for i, _ in MOCKS], k % 6), F.lit("\n\ndef test_run(monkeypatch):\n    x = 1\n"))
    base = F.concat(top, F.when(k % 6 == 3, MOCKS[3][1]).otherwise(""), F.lit("    assert x == 1\n"))
    head = F.concat(top, _pick([m for _, m in MOCKS], k % 6), F.lit("    assert x == 1\n"))
    handing, code = F.lit("from .mod import run\n"), F.lit("# changed\ndef run():\n    return 1\n")
    return _changes(
        customers, _change(_text("tests/test_k", k.cast("string"), ".py"), base, head, F.lit(True)), _change(F.lit("src/pkg/__init__.py"), handing, handing, F.lit(False)),
        _change(F.lit("src/pkg/mod.py"), code, code, k % 4 != 3), _change(F.lit("src/pkg/rest.py"), code, code, k % 4 == 3),
    )


#: What a handler of the head catches, and what it does, each with whether that swallows a failed assertion.
HANDLERS = (("except Exception:", True), ("except ValueError:", False), ("except (KeyError, AssertionError):", True), ("except:", True))
ENDINGS = (("pass", True), ("raise", False), ("if strict:\n            raise", True), ("log()\n        return", True), ("pytest.fail('x')", False))


def handler_pairs(customers: DataFrame) -> DataFrame:
    """A test for each customer whose one to three assertions come into a `try` as HANDLERS and ENDINGS say; one of eleven had been in one before."""
    k = F.col("c_custkey")

    def asserted(indent: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: _text(f"{indent}assert f(", i.cast("string"), ") == 1\n")), "")

    wrapped = _text("    try:\n", asserted("        "), "    ", _pick([h for h, _ in HANDLERS], k % 4), "\n        ", _pick([e for e, _ in ENDINGS], F.floor(k / 4) % 5), "\n")
    top = F.lit("import pytest\n\n\ndef test_try():\n    x = 1\n")
    return _changes(customers, _change(_text("tests/test_h", k.cast("string"), ".py"), F.concat(top, F.when(k % 11 == 0, wrapped).otherwise(asserted("    "))), F.concat(top, wrapped), F.lit(True)))


def changesets(files: DataFrame, *, trailer: str = TRAILER) -> DataFrame:
    """One change set for each cs_id; every ninth carries a trailer that justifies VID009."""
    return _as_changesets(files.select("cs_id").distinct(), trailer)


def order_changesets(orders: DataFrame, *more: Column) -> DataFrame:
    """The change set of each order, with more columns of it, dealt as its files are."""
    return _as_changesets(dealt(orders.select("o_orderkey", *more), "o_orderkey").withColumnRenamed("o_orderkey", "cs_id"), TRAILER)


def _as_changesets(rows: DataFrame, trailer: str) -> DataFrame:
    said = F.when(F.col("cs_id") % 9 == 0, F.array(F.lit("Lower the bar"), F.concat(F.lit("Fix\n\n" + trailer + ": VID009 - ticket "), F.col("cs_id").cast("string")))).otherwise(F.array(F.lit("Fix")))
    return rows.select("*", F.lit("base").alias("base_ref"), F.lit("head").alias("head_ref"), said.alias("commit_messages"), F.lit(None).cast("string").alias("parse_error"))
