from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.config import GateConfig, RuleSetting
from tessera.functions.lines import lines_of, nth_line
from tessera.functions.listvalues import list_value, tokens
from tessera.functions.paths import detect_language, glob_regex, is_test_path, matches_any

GLOBS = [
    ("test_a.py", "**/test_*.py", True), ("a/b/test_a.py", "**/test_*.py", True), ("a/b/my_test_a.py", "**/test_*.py", False), ("src/a/b.py", "src/*.py", False), ("src/b.py", "src/*.py", True),
    ("./src\\b.py", "src/?.py", True), ("x/tests/d/e/f.py", "**/tests/**/*.py", True), ("tests.py", "tests?py", True), ("a1.py", "a[0-9].py", True), ("a!.py", "a[!b].py", True), ("ab.py", "a[&&b].py", True), ("a/b/c", "a/**", True), ("a.b", "a.?", True), ("axb", "a.b", False),
]


def test_globs(spark):
    rows = spark.createDataFrame([(p,) for p, _, _ in GLOBS], "path string")
    for i, (path, glob, expected) in enumerate(GLOBS):
        got = rows.where(F.col("path") == path).select(matches_any(F.col("path"), (glob,)).alias("m")).first()["m"]
        assert got is expected, (i, path, glob)
    with pytest.raises(ValueError, match="empty set"):
        glob_regex("a[]b")


def test_ignored_globs_win_and_languages(spark):
    config = GateConfig(ignore_globs=("gen/**",))
    names = ["gen/test_a.py", "test_a.py", "a.PY", "a.pyi", "a.tsx", "a.d.ts", "a.mjs", "a.jsx", "a.txt", "py"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", is_test_path(F.col("p"), config).alias("t"), detect_language(F.col("p")).alias("l")).collect()
    got = {r["p"]: (r["t"], r["l"]) for r in rows}
    assert got["gen/test_a.py"][0] is False and got["test_a.py"] == (True, "python")
    assert [got[n][1] for n in names[2:]] == [None, "python", "tsx", "typescript", "javascript", "javascript", None, None]


def test_lines(spark):
    text = "one\r\ntwo\x0bthree \nlast\n"
    row = spark.createDataFrame([(text,)], "t string").select(lines_of(F.col("t")).alias("l"), *[nth_line(F.col("t"), F.lit(n)).alias(f"n{n}") for n in (0, 1, 5, 9)], nth_line(F.lit(None).cast("string"), F.lit(1)).alias("null")).first()
    assert row["l"] == text.splitlines() and [row[c] for c in ("n0", "n1", "n5", "n9", "null")] == ["", "one", "last", "", ""]


def test_list_values():
    assert tokens("\"a b\", 'c', d/e.py, \"\"") == ["a b", "c", "d/e.py"]
    assert list_value("omit =\n  [x,\n   y]\n", "omit") == ["x", "y"]
    assert list_value("omit =\n  x\n  y\n", "omit") == [] and list_value("omits = x\n", "omit") is None and list_value('"exclude": ["a"', "exclude") is None


def test_config():
    config = GateConfig.from_yaml("version: 1\nfail_under: 80\ntest_globs: ['t/*.py']\nrules:\n  VID009: {severity: low, penalty: 0}\n")
    assert (config.fail_under, config.test_globs, config.effective("VID009", "high", 20), config.effective("X", "high", 20)) == (80, ("t/*.py",), RuleSetting(True, "low", 0), RuleSetting(True, "high", 20))
    for bad in ({"version": 2}, {"fail_under": 101}, {"unknown": 1}, {"rules": {"A": {"penalty": 101}}}, {"rules": {"A": {"other": 1}}}, {"oracle": {"max_tests": 51}}, {"rules": {"A": {"severity": "bad"}}}):
        with pytest.raises(ValueError):
            GateConfig.of(bad)
    with pytest.raises(ValueError):
        RuleSetting(penalty=-1)
