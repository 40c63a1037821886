"""Both rules over content pairs: every case that fires has one beside it that doesn't."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.config import GateConfig, RuleSetting
from tessera.operators import rules as R
from tessera.sources.pairs import from_pairs

WORKFLOW = ".github/workflows/ci.yml"
RETRY = "jobs:\n  steps:\n    - name: x\n      uses: nick-fields/retry@v3\n      with:\n        command: {}\n"

# name, path, base, head, expected (rule, title, side of the last evidence, line)
CASES = [
    ("lowered", "pyproject.toml", "a\nfail_under = 90\n", "a\nfail_under = 80.5\n", [("VID009", "Coverage threshold lowered", "head", 2)]),
    ("raised", "pyproject.toml", "fail_under = 80\n", "fail_under = 90\n", []),
    ("flag lowered", "tox.ini", "pytest --cov-fail-under=90\n", "pytest --cov-fail-under 70\n", [("VID009", "Coverage threshold lowered", "head", 1)]),
    ("keyed", "jest.config.js", "  branches: 80,\n  lines: 90,\n", "  branches: 60,\n  lines: 95,\n", [("VID009", "Coverage threshold lowered", "head", 1)]),
    ("quoted key", "package.json", '  "lines": 80\n', '  "lines": 60\n', []),
    ("longer key", "jest.config.js", "max_lines: 9\n", "max_lines: 3\n", [("VID009", "Coverage threshold lowered", "head", 1)]),
    ("two edits", "setup.cfg", "fail_under = 90\nx\nfail_under = 80\n", "fail_under = 70\nx\nfail_under = 60\n", []),
    ("no number", "setup.cfg", "fail_under = high\n", "fail_under = low\n", []),
    ("continue", WORKFLOW, "a: 1\n", "a: 1\ncontinue-on-error: true\n", [("VID009", "`continue-on-error: true` added", "head", 2)]),
    ("continue false", WORKFLOW, "a: 1\n", "a: 1\ncontinue-on-error: false\n", []),
    ("continue elsewhere", "Makefile", "a: 1\n", "a: 1\ncontinue-on-error: true\n", []),
    ("two bypasses", "Makefile", "", "\tHUSKY=0 git push --no-verify\n", [("VID009", "`--no-verify` added to a command", "head", 1), ("VID009", "`HUSKY=0` added to a command", "head", 1)]),
    ("no-validate", "Makefile", "", "x --no-validate\n", [("VID009", "`--no-validate` added to a command", "head", 1)]),
    ("longer flag", "Makefile", "", "x --no-verifying\n", []),
    ("strict", "mypy.ini", "[mypy]\nstrict = true\n", "[mypy]\nstrict = False\n", [("VID009", "mypy `strict` downgraded", "head", 2)]),
    ("strict kept", "mypy.ini", "[mypy]\nstrict = true\n", "[mypy]\nstrict = true\nx = 1\n", []),
    ("exit zero", "tox.ini", "flake8\n", "flake8 --exit-zero\n", [("VID009", "`--exit-zero` added to a linter invocation", "head", 1)]),
    ("or true", WORKFLOW, "  run: make lint\n", "  run: make lint || true\n", [("VID009", "`|| true` appended to a check command", "head", 1)]),
    ("or true, new", WORKFLOW, "a\n", "a\nrm x || true\n", []),
    ("timeout x3", WORKFLOW, "timeout-minutes: 10\n", "timeout-minutes: 30\n", [("VID009", "Test timeout raised substantially", "head", 1)]),
    ("timeout x2", WORKFLOW, "timeout-minutes: 10\n", "timeout-minutes: 20\n", [("VID009", "Test timeout raised substantially", "head", 1)]),
    ("timeout x1.2", WORKFLOW, "timeout-minutes: 10\n", "timeout-minutes: 12\n", []),
    ("timeout from 0", WORKFLOW, "timeout-minutes: 0\n", "timeout-minutes: 12\n", []),
    ("retry of tests", WORKFLOW, "jobs:\n", RETRY.format("npm run test"), [("VID009", "Retry wrapper added around a test step", "head", 4)]),
    ("retry of deploy", WORKFLOW, "jobs:\n", RETRY.format("deploy"), []),
    ("out of scope", "docs/pyproject.toml", "fail_under = 90\n", "fail_under = 10\n", []),
    ("ignored test", "pytest.ini", "addopts = -q\n", "addopts = -q --ignore=tests/slow --ignore=build\n", [("VID010", "Test path newly ignored by pytest", "head", 1)]),
    ("ignore reformatted", "pytest.ini", "addopts = --ignore=tests/abc\n", "addopts =  --ignore=tests/a\n", []),
    ("norecursedirs", "pytest.ini", "norecursedirs = build\n", "norecursedirs = build tests/old\n", [("VID010", "Test directory added to `norecursedirs`", "head", 1)]),
    ("norecursedirs, plain", "pytest.ini", "norecursedirs = build\n", "norecursedirs = build dist\n", []),
    ("testpaths narrowed", "pyproject.toml", 'testpaths = ["tests", "more"]\n', 'testpaths = ["tests"]\n', [("VID010", "`testpaths` narrowed", "base", 1)]),
    ("testpaths widened", "pyproject.toml", 'testpaths = ["tests"]\n', 'testpaths = ["tests", "more"]\n', []),
    ("testpaths unreadable", "pyproject.toml", 'testpaths = ["tests"]\n', 'testpaths = ["tests"\n', [("VID010", "`testpaths` narrowed", "base", 1)]),
    ("conftest", "a/conftest.py", "collect_ignore = []\n", 'collect_ignore = [\n  "test_x.py",\n]\n', [("VID010", "Test file added to `collect_ignore`", "head", 2)]),
    ("js ignore", "jest.config.js", "testPathIgnorePatterns: ['x'],\n", "testPathIgnorePatterns: ['x', 'e2e.spec'],\n", [("VID010", "Test path newly excluded", "head", 1)]),
    ("js exclude", "vitest.config.ts", "exclude: []\n", "exclude: ['a/tests']\n", [("VID010", "Test path newly excluded", "head", 1)]),
    ("testMatch", "package.json", '"testMatch": ["a", "b"]\n', '"testMatch": ["a"]\n', [("VID010", "`testMatch` narrowed", "base", 1)]),
    ("omit", ".coveragerc", "omit = a.py\n", "omit = a.py latest/b.py\n", [("VID010", "Test file added to coverage `omit`", "head", 1)]),
    ("exclude_lines", ".coveragerc", 'exclude_lines = ["x"]\n', 'exclude_lines = ["x", "def test_"]\n', [("VID010", "Coverage `exclude_lines` widened to hide tests", "head", 1)]),
    ("exclude_lines, ordinary", ".coveragerc", 'exclude_lines = ["x"]\n', 'exclude_lines = ["x", "pragma"]\n', []),
    ("unterminated", "pytest.ini", "norecursedirs = []\n", 'norecursedirs = ["tests/a"\n', []),
    ("gitignore", "pkg/.gitignore", "*.o\n", "*.o\n# tests\npkg/test_a.py\ndocs/\n", [("VID010", "Test path added to `.gitignore`", "head", 3)]),
    ("new config", "pytest.ini", None, "norecursedirs = tests\naddopts = --exit-zero\n", [("VID009", "`--exit-zero` added to a linter invocation", "head", 2)]),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, 0, path, "added" if base is None else "modified", None, base, head, False) for i, (_, path, base, head, _) in enumerate(CASES)]
    return from_pairs(spark.createDataFrame(rows, "cs_id long, file_ord int, path string, kind string, base_path string, base_content string, head_content string, is_binary boolean")).persist()


@pytest.fixture(scope="module")
def found(files):
    core = tuple(r for r in R.discover() if r.id in ("VID009", "VID010"))
    return R.findings(R.Context(files), core).orderBy("file_ord", "check_ord", "line_ord").collect()


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_case(found, i):
    own = [(f["rule_id"], f["title"], f["evidence"][-1]["side"], f["evidence"][-1]["line"]) for f in found if f["cs_id"] == i]
    assert sorted(own) == sorted(CASES[i][4])


def test_details_and_defaults(found):
    first = next(f for f in found if f["cs_id"] == 0)
    assert first["detail"] == "`fail_under` dropped from 90 to 80.5 in pyproject.toml." and (first["severity"], first["penalty"]) == ("high", 20)
    assert [(e["side"], e["line"], e["snippet"]) for e in first["evidence"]] == [("base", 2, "fail_under = 90"), ("head", 2, "fail_under = 80.5")]
    longer = next(f for f in found if f["title"].startswith("Test timeout"))
    assert longer["detail"] == "`timeout-minutes` rose from 10 to 30 in .github/workflows/ci.yml, more than 2x."


def test_configuration(files):
    config = GateConfig(rules={"VID010": RuleSetting(enabled=False), "VID009": RuleSetting(severity="low", penalty=0)})
    rows = R.findings(R.Context(files, config), tuple(r for r in R.discover() if r.id in ("VID009", "VID010")))
    assert {(r["rule_id"], r["severity"], r["penalty"]) for r in rows.collect()} == {("VID009", "low", 0)}


def test_binary_files_never_fire(files):
    rows = R.findings(R.Context(files.withColumn("is_binary", F.lit(True))), tuple(r for r in R.discover() if r.id in ("VID009", "VID010")))
    assert rows.count() == 0


def test_registry():
    assert [r.id for r in R.discover()] == sorted(r.id for r in R.registered()) and R.get_rule("VID009").name == "CI threshold lowered" and R.get_rule("NONE") is None
    with pytest.raises(TypeError):
        R.rule("", "nameless")
    kept = R.get_rule("VID009")
    try:
        R.rule("VID009", "later")(lambda c: None)
        assert R.get_rule("VID009").name == "later"
    finally:
        R._RULES["VID009"] = kept
