"""VID010: a test that still exists was taken out of discovery, collection or coverage by configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import GateConfig
from tessera.functions.lines import bound, line_texts, lines_of, matching_lines, stripped
from tessera.functions.listvalues import list_values, locate
from tessera.functions.paths import looks_test_related, matches_any
from tessera.operators.rules import changed, each_found, evidence, found, found_if, rule, text

# Scopes, list settings and titles.
PYTEST_FILES = ("pyproject.toml", "setup.cfg", "tox.ini", "pytest.ini", "**/conftest.py")
JS_FILES = ("jest.config.*", "vitest.config.*", "package.json")
COVERAGE_FILES = (".coveragerc", "pyproject.toml", "setup.cfg")
IGNORE_FILES = (".gitignore", "**/.gitignore")
IGNORE_FLAG = r"--ignore=(\S+)"


@dataclass(frozen=True)
class ListCheck:
    """A list setting whose items were added to (an exclusion) or removed from (an inclusion)."""

    order: int
    key: str
    files: tuple[str, ...]
    added: bool
    title: str
    before_item: str
    after_item: str
    end: str


LISTS = (
    ListCheck(20, "norecursedirs", PYTEST_FILES, True, "Test directory added to `norecursedirs`", "`", "` was added to `norecursedirs` in ", ", so pytest skips it."),
    ListCheck(21, "collect_ignore", PYTEST_FILES, True, "Test file added to `collect_ignore`", "`", "` was added to `collect_ignore` in ", "."),
    ListCheck(22, "testpaths", PYTEST_FILES, False, "`testpaths` narrowed", "`", "` was dropped from `testpaths` in ", "; pytest no longer discovers it."),
    ListCheck(30, "testPathIgnorePatterns", JS_FILES, True, "Test path newly excluded", "`", "` was added to `testPathIgnorePatterns` in ", "."),
    ListCheck(31, "exclude", JS_FILES, True, "Test path newly excluded", "`", "` was added to `exclude` in ", "."),
    ListCheck(32, "testMatch", JS_FILES, False, "`testMatch` narrowed", "`", "` was dropped from `testMatch` in ", "; matching tests stop running."),
    ListCheck(40, "omit", COVERAGE_FILES, True, "Test file added to coverage `omit`", "`", "` was added to `omit` in ", "."),
    ListCheck(41, "exclude_lines", COVERAGE_FILES, True, "Coverage `exclude_lines` widened to hide tests", "A new pattern `", "` was added to `exclude_lines` in ", "."),
)


def newly_ignored(config: GateConfig) -> Column:
    """`--ignore=` flags of added lines whose text no removed line of the file has."""

    def of_line(line: Column, gone: Column) -> Column:
        items = F.regexp_extract_all(line["text"], F.lit(IGNORE_FLAG), F.lit(1))
        new = F.filter(items, lambda item: ~F.contains(gone, F.concat(F.lit("--ignore="), item)) & looks_test_related(item, config))
        cited = F.array(evidence(line["line_no"], "head", stripped(line["text"])))
        return F.transform(new, lambda item: found(F.lit("Test path newly ignored by pytest"), text("`--ignore=", item, "` was added in ", F.col("path"), "."), cited, 10, line["line_ord"]))

    flagged = matching_lines(F.col("added"), lambda body: F.contains(body, F.lit("--ignore=")))
    each = bound(line_texts(F.col("removed")), lambda gone: F.flatten(F.transform(flagged, lambda x: of_line(x, gone))))
    return found_if(F.contains("came", F.lit("--ignore=")) & matches_any(F.col("path"), PYTEST_FILES), each)


def newly_git_ignored(config: GateConfig) -> Column:
    def told(x: Column) -> Column:
        return bound(stripped(x["text"]), lambda clean: found(F.lit("Test path added to `.gitignore`"), text("`", clean, "` was added to ", F.col("path"), " and matches the test globs."), F.array(evidence(x["line_no"], "head", clean)), 0, x["line_ord"]))

    def hidden(body: Column) -> Column:
        return bound(stripped(body), lambda clean: (clean != "") & ~clean.startswith("#") & matches_any(clean, config.test_globs))

    return found_if(F.col("path").contains(".gitignore") & matches_any(F.col("path"), IGNORE_FILES), F.transform(matching_lines(F.col("added"), hidden), told))


def lists_changed(config: GateConfig) -> Column:
    """Items that joined or left the list settings of a file. Both contents must be known. An addition needs a
    readable list at the head, a removal one at the base; the other side's missing or unreadable list is empty."""
    path, base, head = F.col("path"), F.col("base_content"), F.col("head_content")
    none = F.expr("cast(array() as array<string>)")

    def items(read: Column, c: ListCheck) -> Column:
        here, there = ("now", "was") if c.added else ("was", "now")
        own = F.array_sort(F.array_except(F.coalesce(F.try_element_at(read[here], F.lit(c.key)), none), F.coalesce(F.try_element_at(read[there], F.lit(c.key)), none)))
        listed = F.transform(own, lambda x: F.struct(F.lit(c.order).alias("check_ord"), F.lit(c.title).alias("title"), x.alias("item"), text(c.before_item, x, c.after_item, path, c.end).alias("detail"), F.lit(c.added).alias("added")))
        return F.when(matches_any(path, c.files), listed)

    def changes(read: Column) -> Column:
        whole = F.flatten(F.filter(F.array(*[items(read, c) for c in LISTS]), lambda a: a.isNotNull()))
        return F.filter(whole, lambda x: ~x["added"] | looks_test_related(x["item"], config))

    def placed(x: Column, i: Column) -> Column:
        line = locate(lines_of(F.when(x["added"], head).otherwise(base)), x["item"])
        side = F.when(x["added"], "head").otherwise("base")
        return found(x["title"], x["detail"], F.array(evidence(line, side, x["item"])), x["check_ord"], i)

    keys = tuple(c.key for c in LISTS)
    read = F.struct(list_values(base, keys).alias("was"), list_values(head, keys).alias("now"))
    all_found = bound(read, lambda r: F.filter(F.transform(changes(r), placed), lambda f: F.get(f["evidence"], F.lit(0))["line"].isNotNull()))
    return found_if(base.isNotNull() & head.isNotNull() & matches_any(path, sorted({g for c in LISTS for g in c.files})), all_found)


def _in_text_files(files: DataFrame, check: Column) -> DataFrame:
    return each_found(changed(files.where(~F.col("is_binary"))), lambda rows: (rows, check))


def ignored_by_pytest(files: DataFrame, config: GateConfig) -> DataFrame:
    return _in_text_files(files, newly_ignored(config))


def git_ignored(files: DataFrame, config: GateConfig) -> DataFrame:
    return _in_text_files(files, newly_git_ignored(config))


def list_changes(files: DataFrame, config: GateConfig) -> DataFrame:
    return _in_text_files(files, lists_changed(config))


@rule("VID010", "Test file excluded via config", severity="high", penalty=20, of_file=True)
def test_excluded(rows: DataFrame, config: GateConfig) -> tuple[DataFrame, Column]:
    return rows, F.concat(newly_git_ignored(config), newly_ignored(config), lists_changed(config))


test_excluded.__test__ = False
